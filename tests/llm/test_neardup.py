"""Near duplicates and the pipeline against brute force."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import neardup
from factweave.plans import storage
from factweave.llm.shingles import WORD, bag, bag_signatures, mix, overlap, shingle_hashes, shingles_of, word_hashes, words_of


def test_signature_share_is_the_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for k in range(20):
        a = rng.integers(0, 150, 300) + 1000 * k
        b = np.concatenate([a[: 150 + 7 * k], rng.integers(200, 400, 150 - 7 * k) + 1000 * k])
        bags = [np.unique(mix(x.astype(np.uint64)), return_counts=True) for x in (a, b)]
        owner = np.repeat([0, 1], [len(x[0]) for x in bags])
        sig = bag_signatures(owner, np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags]), 2, 512)
        errors.append((sig[0] == sig[1]).mean() - overlap(*bags))
    assert abs(np.mean(errors)) < 0.015 and max(map(abs, errors)) < 0.09


def test_words_and_shingles_of_many_texts_equal_those_of_each():
    every = ["".join(map(chr, range(k, k + 4096))) for k in range(0, 0x110000, 4096)]
    for texts in ([], [""], ["", "a"], ["a b", "", "...", "A b c, d e f_1"], ["x" * 200_000, "y z"], corpus()[:40], every):
        texts = [t or "" for t in texts]
        words, counts = words_of(texts)
        assert counts.tolist() == [len(WORD.findall(t.lower())) for t in texts]
        plain = [w for t in texts for w in WORD.findall(t.lower())]
        assert len(set(zip(plain, words.tolist(), strict=True))) == len(set(plain)) == len(set(words.tolist()))
        grams, sizes = shingles_of(words, counts, 5)
        each = [shingle_hashes(words[at - n : at], 5).tolist() for n, at in zip(counts, np.cumsum(counts), strict=True)]
        assert sizes.tolist() == list(map(len, each)) and grams.tolist() == sum(each, [])


def test_signing_costs_little_more_than_plain_hashing_of_words():
    rng = random.Random(6)
    texts = [" ".join(f"{rng.randrange(10**9):x}" for _ in range(500)) for _ in range(400)]
    began = time.process_time()
    for t in texts:
        word_hashes(t)
    plain = time.process_time() - began
    words_of(["a"])
    began = time.process_time()
    grams, sizes = shingles_of(*words_of(texts), 5)
    for lo in range(0, 400, 100):
        flat, owner = grams[sizes[:lo].sum() : sizes[: lo + 100].sum()], np.repeat(np.arange(100), sizes[lo : lo + 100])
        bag_signatures(owner, flat, np.ones(len(flat), np.int64), 100, 180)
    assert time.process_time() - began < 1.1 * plain


def corpus(seed=3, families=14):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    texts = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 250))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(texts[-1].upper() + "!")
    rng.shuffle(texts)
    return [*texts, None, "", "...", "...", "one", "one", "one two", "a b c d e f g " * 3000]


def brute_classes(texts):
    bags = {k: bag(t or "", 5) for k, t in enumerate(texts)}
    held = defaultdict(list)
    for k, (h, _) in bags.items():
        for x in h.tolist():
            held[x].append(k)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(x, y) for ks in held.values() for x in ks for y in ks if x < y}:
        if overlap(bags[a], bags[b]) >= 0.8:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in range(len(texts))}


@pytest.mark.parametrize("seed", [3, 11])
def test_classes_equal_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, node long")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)


def test_large_tables_take_the_shuffled_way(spark, monkeypatch):
    monkeypatch.setattr(storage, "SMALL_ROWS", -1)
    monkeypatch.setattr(neardup, "PART", 7)
    texts = corpus(5, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == brute_classes(texts)


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    for n, m in ((1, 0), (50, 30), (400, 380), (300, 299)):
        edges = [(k, k + 1) for k in range(299)] if m == 299 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        frame = spark.createDataFrame(edges, "a long, b long")
        got = {r.node: r.root for r in neardup.classes(frame, neardup.Scratch()).collect()}
        assert got == {k: root[k] for a, b in edges if a != b for k in (a, b)}


def test_pairs_by_size_at_exactly_the_threshold(spark):
    rows = []
    for common in range(4, 4001, 4):  # two members that share just this much, so that they are at 0.8
        both = common * 9 // 4
        rows += [(2 * common, -common, both // 2, common, 2 * common, -common), (2 * common + 1, -common, both - both // 2, common, 2 * common + 1, -common)]
    placed = spark.createDataFrame(rows, "node long, hub long, n_shingles long, common long, label long, hub_label long")
    got = {(r.node, r.hub) for r in neardup._by_size(placed, 0.8).collect()}
    assert got == {(2 * c, 2 * c + 1) for c in range(4, 4001, 4)}


def test_excerpts_of_a_hub_are_linked(spark):
    base = [f"w{k}" for k in range(104)]
    texts = [" ".join(x) for x in (base, base[:60] + [f"x{k}" for k in range(7)], base[:60] + [f"y{k}" for k in range(7)], [*base, "z"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sigs = neardup.signatures(docs, "id").select(F.col("id").alias("node"), "n_shingles", "marks")
    # The hub is in two buckets; the excerpts meet only there, at 56 of 70 shingles, and add nothing in common.
    members = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 3)], "bucket long, node long").join(sigs.drop("marks"), "node").select("bucket", "node", "n_shingles")
    found = neardup.links(members, sigs.select("node", "marks"), lambda ids, few: docs.join(ids, "id", "left_semi"), 0.8, 5, 180, neardup.Scratch())
    assert {(r.node, r.label) for r in found.collect()} == {(0, 0), (3, 0), (1, 1), (2, 1)}


def test_deduplicated_keeps_one_of_each_class(spark):
    texts = corpus(4, 4)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, bands long")
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(texts).values()))


def test_deduplicated_with_repeated_ids(spark):
    long = "a b c d e f g h i j k l"
    rows = [(1, long, "x"), (1, long, "x"), (1, "other words stand here", "x"), (2, long + " m", "y"), (None, long, "z"), (3, None, "z"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_key_of string")
    got = sorted(map(str, neardup.deduplicated(docs).collect()))
    assert got == sorted(map(str, spark.createDataFrame([rows[0], rows[2], rows[4], rows[5]], docs.schema).collect()))


def test_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == 0
    rows = [(1, "a b c d e f g"), (1, "z"), (None, "x"), (2, "a b c d e f g")]
    got = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, docs.schema)).collect()}
    assert got == {(1, 1), (2, 1), (None, None)}


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.schema.names == first.schema.names
        docs = neardup.stored(docs, "stage")
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > 0.7 * counts[0]
    assert docs.where("not round_trip").count() == 0
    assert docs.count() == corpus_pipeline.run(spark, sf).count()


def test_pipeline_equals_plain_steps_on_odd_rows(spark, tmp_path):
    """Every stage against a plain version, on nulls, empty texts, repeated rows and ids, ties and extra columns."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    odd = [(9001, None, None, None, None), (9002, "", "en", "x", 0), (9002, "", "en", "x", 0), (None, "No id stands here.", "en", "x", 18), rows[0], rows[0], (9003, rows[1][1], "de", "y", 5), (9004, f"Before. {item} After.", "en", "x", 9), (9005, "Write to jo@ex.com or 10.0.0.1.", "en", "z", 31)]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame(rows + odd, schema).withColumn("bucket", F.lit(1)).withColumn("found", F.lit("f"))
    counts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = neardup.stored(stage(spark, docs, sf), name)
        after = docs.collect()
        counts[name] = len(after)
        if k < 4:
            assert docs.columns == [*schema.names, "bucket", "found"]
        if name == "toxicity":
            assert set(map(str, after)) <= set(map(str, before)) and sum(r.doc_id is None for r in after) == 1
        if name == "near_duplicates":
            named = [r for r in before if r.doc_id is not None]
            different = sorted({(r.doc_id, r.text) for r in named}, key=str)
            roots = brute_classes([t for _, t in different])
            classes = {}
            for x, root in roots.items():
                classes.setdefault(root, []).append(different[x])
            wanted = sorted((min(c, key=lambda x: x[0]) for c in classes.values()), key=str)
            assert sorted(((r.doc_id, r.text) for r in after if r.doc_id is not None), key=str) == wanted
        if name == "decontamination":
            assert {str(r) for r in before} - {str(r) for r in after} >= {str(r) for r in before if r.doc_id == 9004}
        if name == "personal_data":
            clean = {r.doc_id: r for r in after}
            assert clean[9005].text == "Write to <EMAIL> or <IP>." and clean[9005].n_chars == len(clean[9005].text)
            assert clean[9001].text is None and clean[9001].n_chars is None and len(after) == len(before)
    assert counts["pieces"] == counts["personal_data"] and docs.where("not round_trip").count() == 0
    assert docs.where("doc_id = 9001").first().n_tokens == 0

"""Clone detection: exact groups, repeated lines and runs, shared shingles, trigram index."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A shingle in more functions than this says nothing about two of them; a candidate pair must share this many.
MOST_POSTINGS, LEAST_SHARED = 40, 4
#: A subtree below any of these is trivial.
LEAST_NODES, LEAST_DEPTH, LEAST_TOKENS, LEAST_VOLUME = 8, 3, 4, 30.0


def exact_clusters(fragments: DataFrame) -> DataFrame:
    """Groups of two or more fragments of equal language and body hash.

    fragments: language, body, file_path, n_nodes, n_tokens.  score = nodes * log2(distinct tokens + 1), 20 more across
    files.
    """
    g = fragments.groupBy("language", F.sha2(F.col("body").cast("binary"), 256).alias("hash"))
    out = g.agg(F.count("*").alias("size"), F.countDistinct("file_path").alias("n_files"), F.avg("n_nodes").alias("nodes"), F.avg("n_tokens").alias("tokens")).where("size > 1")
    score = F.col("nodes") * F.log2(F.greatest(F.col("tokens") + 1, F.lit(2))) + F.when(F.col("n_files") > 1, 20.0).otherwise(0.0)
    return out.withColumn("score", F.round(score, 4))


def shingles(tokens: DataFrame, id_col: str, tokens_col: str, size: int = 5, hashed: bool = False) -> DataFrame:
    """id and each distinct run of `size` tokens, as text or, for joins over many texts, as 64-bit hash."""
    at = F.sequence(F.lit(1), F.size(tokens_col) - size + 1)
    run = lambda i: F.slice(tokens_col, i, F.lit(size))
    runs = F.transform(at, lambda i: F.xxhash64(run(i)) if hashed else F.array_join(run(i), " "))
    return tokens.where(F.size(tokens_col) >= size).select(F.col(id_col).alias("id"), F.explode(F.array_distinct(runs)).alias("shingle"))


def shared_shingles(grams: DataFrame, most: int = MOST_POSTINGS, least: int = LEAST_SHARED) -> DataFrame:
    """left, right and shared of pairs with enough common shingles; very common shingles don't count.

    The limit on postings is part of the operator's meaning, and it bounds the pairs of a shingle.
    """
    rare = grams.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("shingle")
    kept = grams.join(rare, "shingle")
    a, b = kept.select("shingle", F.col("id").alias("left")), kept.select("shingle", F.col("id").alias("right"))
    return a.join(b, "shingle").where("left < right").groupBy("left", "right").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def near_clones(pairs: DataFrame, bodies: DataFrame, min_similarity: float = 0.85, max_regions: int = 2, max_changed: int = 20) -> DataFrame:
    """Candidate pairs (left, right) whose token sequences differ in few small regions.

    bodies: id, tokens.  Gives similarity, regions and changed.
    """
    both = pairs.join(bodies.select(F.col("id").alias("left"), F.col("tokens").alias("a")), "left").join(bodies.select(F.col("id").alias("right"), F.col("tokens").alias("b")), "right")

    def compare(parts):
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                m = SequenceMatcher(None, list(row.a), list(row.b), autojunk=False)
                edits = [x for x in m.get_opcodes() if x[0] != "equal"]
                changed = sum(max(x[2] - x[1], x[4] - x[3]) for x in edits)
                if m.ratio() >= min_similarity and 0 < len(edits) <= max_regions and changed <= max_changed:
                    rows.append((row.left, row.right, m.ratio(), len(edits), changed))
            yield pd.DataFrame(rows, columns=["left", "right", "similarity", "regions", "changed"])

    kind = bodies.schema["id"].dataType.simpleString()
    return both.select("left", "right", "a", "b").mapInPandas(compare, f"left {kind}, right {kind}, similarity double, regions int, changed int")


def repeated_lines(lines: DataFrame, least: int = 2) -> DataFrame:
    """Non-blank lines that stand in `least` or more places, with the number of places and of texts."""
    return lines.where(F.trim("line_text") != "").groupBy("line_text").agg(F.count("*").alias("n_places"), F.countDistinct("id").alias("n_texts")).where(F.col("n_places") >= least)


def repeated_runs(sequences: DataFrame, least: int = 4) -> DataFrame:
    """Maximal repeated runs of statements inside each group (group, seq_id, items): length and the places.

    Longest first, places of a run don't overlap, and runs whose places all lie within reported ones are left out.
    Each group is one task's work, as a run is only compared within its group.
    """

    def runs(part: pd.DataFrame) -> pd.DataFrame:
        found = maximal_runs({r.seq_id: list(r["items"]) for _, r in part.iterrows()}, least)
        rows = [(part["group"].iloc[0], size, len(places), ";".join(f"{s}:{p}" for s, p in places)) for size, places in found]
        return pd.DataFrame(rows, columns=["group", "length", "members", "places"])

    kind = sequences.schema["group"].dataType.simpleString()
    return sequences.groupBy("group").applyInPandas(runs, f"group {kind}, length int, members int, places string")


def maximal_runs(sequences: dict, least: int) -> list[tuple[int, list[tuple]]]:
    """(length, [(sequence, start)...]) of repeated runs, longest first.

    Lengths are tried from the longest repeat down; equal windows are found through ranks by doubling, so comparing two windows
    costs constant time.
    """
    names, flat, owner, start = sorted(sequences), [], [], []
    for n in names:
        for k, x in enumerate(sequences[n]):
            flat.append(x)
            owner.append(n)
            start.append(k)
    size = len(flat)
    number: dict = {}
    rank = [number.setdefault(x, len(number)) for x in flat]
    room = [0] * size
    for k in range(size - 1, -1, -1):
        room[k] = room[k + 1] + 1 if k + 1 < size and owner[k + 1] == owner[k] else 1
    ranks, width = {1: rank}, 1
    while width * 2 <= size:
        prev, table = ranks[width], {}
        ranks[width * 2] = [table.setdefault((prev[k], prev[k + width]), len(table)) if room[k] >= 2 * width else -1 for k in range(size)]
        width *= 2

    def key(k: int, length: int):
        w = 1 << (length.bit_length() - 1)
        return ranks[w][k], ranks[w][k + length - w]

    def repeats(length: int) -> list[list[int]]:
        groups: dict = {}
        for k in range(size):
            if room[k] >= length:
                groups.setdefault(key(k, length), []).append(k)
        out = []
        for places in groups.values():
            chosen: list[int] = []
            for p in places:
                if not chosen or owner[chosen[-1]] != owner[p] or p >= chosen[-1] + length:
                    chosen.append(p)
            if len(chosen) > 1:
                out.append(chosen)
        return out

    lo, hi = least - 1, size
    while lo < hi:  # the longest length that repeats
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if repeats(mid) else (lo, mid - 1)
    out, covered = [], [False] * size
    for length in range(lo, least - 1, -1):
        for chosen in repeats(length):
            if all(all(covered[p : p + length]) for p in chosen):
                continue
            out.append((length, [(owner[p], start[p]) for p in chosen]))
            for p in chosen:
                covered[p : p + length] = [True] * length
    return out


def trigrams(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index rows: trigram and id, distinct."""
    low = F.lower(F.col(text_col))
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3)))
    return texts.where(F.length(low) >= 3).select(F.explode(F.array_distinct(grams)).alias("trigram"), F.col(id_col).alias("id"))


def trigram_search(index: DataFrame, query: str) -> DataFrame:
    """ids that hold all trigrams of the query."""
    q = query.lower()
    wanted = sorted({q[k : k + 3] for k in range(len(q) - 2)})
    return index.where(F.col("trigram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")


def is_trivial(kinds: Column, tokens: Column, depth: Column, keywords: list[str]) -> Column:
    """Whether a subtree is too small to compare: few nodes, flat, few different tokens besides keywords, or little volume.

    Volume is the number of nodes times the logarithm of the number of different kinds and tokens.
    """
    nodes = F.size(kinds)
    own = F.size(F.array_except(F.array_distinct(tokens), F.array(*map(F.lit, keywords)) if keywords else F.array().cast("array<string>")))
    volume = nodes * F.log2(F.greatest(F.size(F.array_distinct(F.concat(kinds, tokens))), F.lit(1)))
    return (nodes < LEAST_NODES) | (depth < LEAST_DEPTH) | (own < LEAST_TOKENS) | (volume < LEAST_VOLUME)


def canonical_hash(kinds: Column, tokens: Column) -> Column:
    """Hash of a subtree's kinds and tokens."""
    return F.sha2(F.concat(F.concat_ws(" ", kinds), F.lit("##"), F.concat_ws(" ", tokens)).cast("binary"), 256)


def penalty(symbol: Column, kinds: Column, tokens: Column, one_file: Column) -> Column:
    """What makes a cluster of equal subtrees less worth showing; the sum of what applies.

    Stubs that only raise NotImplemented 1000, small isinstance guards and wrappers of one attribute 500, fragments of one file 300,
    bodies of self.x = x and special methods 200.
    """
    nodes = F.size(kinds)
    has = lambda *t: F.arrays_overlap(tokens, F.array(*map(F.lit, t)))
    stub = has("NotImplementedError", "NotImplemented") & F.array_contains(kinds, "raise") & (nodes <= 12)
    guard = has("isinstance") & (nodes <= 20)
    wrapper = has("self") & F.array_contains(kinds, "return") & F.array_contains(kinds, "attribute") & (nodes <= 8) & ~F.array_contains(kinds, "call")
    fragment = one_file & (nodes < 15)
    selfs = has("self") & (F.size(F.filter(kinds, lambda k: k == "assignment")) >= 2) & ~F.array_contains(kinds, "call")
    special = symbol.rlike(r"(^|\.)__\w+__$")
    points = ((stub, 1000), (guard, 500), (wrapper, 500), (fragment, 300), (selfs, 200), (special, 200))
    return sum((F.when(c, float(n)).otherwise(0.0) for c, n in points), F.lit(0.0))


def ranked(clusters: DataFrame, least_score: float = 0.0, limit: int | None = 50) -> DataFrame:
    """Clusters (score, size, hash) by score, then size; `limit` is the report's length."""
    out = clusters.where(F.col("score") >= least_score).orderBy(F.desc("score"), F.desc("size"), "hash")
    return out if limit is None else out.limit(limit)


def run_clusters(runs: DataFrame) -> DataFrame:
    """Repeated runs (length, members, n_kinds, n_files) with their score: 10 a statement, up to 15 for kinds, 20 across files."""
    score = F.col("length") * 10.0 + F.least(F.col("n_kinds") * 3.0, F.lit(15.0)) + F.when(F.col("n_files") > 1, 20.0).otherwise(0.0)
    return runs.withColumn("score", score)


def in_order(pairs: DataFrame) -> DataFrame:
    """Near clones by category, similarity, and names."""
    return pairs.orderBy("category", F.desc("similarity"), "left", "right")


def subtree_clusters(subtrees: DataFrame, keywords: list[str] = (), across_files: bool | None = None) -> DataFrame:
    """hash, size, n_files, nodes, score of equal subtrees (file_path, symbol, kinds, tokens, depth) that aren't trivial.

    score: nodes times the logarithm of the different tokens, 20 more across files, less what speaks against showing it.  across_files
    keeps clusters of several files, or of one, only.
    """
    kept = subtrees.where(~is_trivial(F.col("kinds"), F.col("tokens"), F.col("depth"), list(keywords))).withColumn("hash", canonical_hash(F.col("kinds"), F.col("tokens")))
    first = F.min(F.struct("symbol", "kinds", "tokens")).alias("one")
    out = kept.groupBy("hash").agg(F.count("*").alias("size"), F.countDistinct("file_path").alias("n_files"), first).where("size > 1")
    nodes = F.size("one.kinds")
    score = nodes * F.log2(F.greatest(F.size(F.array_distinct(F.col("one.tokens"))) + 1, F.lit(2))) + F.when(F.col("n_files") > 1, 20.0).otherwise(0.0)
    minus = penalty(F.col("one.symbol"), F.col("one.kinds"), F.col("one.tokens"), F.col("n_files") == 1)
    if across_files is not None:
        out = out.where((F.col("n_files") > 1) == across_files)
    return out.select("hash", "size", "n_files", nodes.alias("nodes"), F.round(score - minus, 4).alias("score"))

"""Training-data operators against brute force, on small and odd inputs."""

import hashlib
import json
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from factweave.llm import decontam, htmltext, langid, pieces, pii, quality, queries, tokens, toxicity, transducers, urls

ODD = ["", None, " ", "   a   b  ", "\n\n", "a▁b", "aaaaaaaaaaaaaaaaaaaa", "日本語 🎉 é\u0000", "x" * 3000, " " * 500 + "y", "1 " * 2000, "\t\r\n　x"]


def frame(spark, texts):
    """Texts with ids, an unused column, and a repeated row."""
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, decoded string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# -- pieces -------------------------------------------------------------------
def test_pieces_equal_the_library():
    model = queries.tokenizer_file("piece_bpe_32k.model")
    own, library = pieces.codec(model), sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(3)
    letters = "aeth inosrl▁ \n.,é日🎉0123#%$ABC-_()"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(600)]
    for text in texts:
        expected = library.encode(text)
        assert own.encode(text).tolist() == expected
        assert own.decode(expected) == library.decode(expected)
    for _ in range(300):  # ids that no text is encoded to: byte pieces that are no UTF-8, pieces in any order
        ids = [own.id_of[pieces.SPACE], *(rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(12))]
        ids = [i for i in ids if i in own.byte_of or own.text[i] in own.id_of]
        assert own.decode(ids) == library.decode(ids)


def test_pieces_query_shape(spark):
    model = queries.tokenizer_file("piece_bpe_32k.model")
    coded = pieces.encode_decode(frame(spark, ODD), model).collect()
    assert len(coded) == len(ODD) + 1
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in coded:
        assert list(r.ids) == library.encode(ODD[r.doc_id] or "") and r.decoded == library.decode(list(r.ids))
    assert {r.doc_id: list(r.ids) for r in coded}[1] == []
    assert pieces.encode_decode(empty(spark), queries.tokenizer_file("piece_bpe_32k.model")).count() == 0
    with pytest.raises(ValueError, match="carried"):
        pieces.encode_decode(frame(spark, ODD), "x", ("decoded",))


# -- token counts -----------------------------------------------------------------
def test_context_report_equals_counting(spark):
    rng = random.Random(5)
    lengths = [rng.choice([0, 3, rng.randint(0, 2000)]) for _ in range(400)]
    hist = tokens.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    rows = tokens.context_report(hist).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_up_to == sum(n <= r.n_tokens for n in lengths)
        assert r.tokens_up_to == sum(n for n in lengths if n <= r.n_tokens)
        assert r.tokens_over == sum(n for n in lengths if n > r.n_tokens)
        assert r.tokens_truncated == sum(min(n, r.n_tokens) for n in lengths)
        assert r.quantile == pytest.approx(r.docs_up_to / len(lengths))


def test_token_counts_on_odd_texts(spark):
    import importlib

    pattern = importlib.import_module("public_tokenizers").PATTERN
    path = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(frame(spark, ODD), path, pattern).collect()}
    assert got[0] == got[1] == 0 and got[2] == 1
    assert tokens.context_report(tokens.length_histogram(tokens.token_counts(empty(spark), path, pattern))).count() == 0


# -- personal data -------------------------------------------------------------------
def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(f"email:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(f"ip:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[ -]", "", m[0])][::-1]
        if 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0:
            out.append(f"card:{m.start()}:{m.end()}")
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(f"phone:{m.start()}:{m.end()}")
    return ",".join(out)


PII = [
    *ODD, "a@b.c", "a@b.c_d@e.f x", "@@@", "1.2.3.4.5.6.7.8 999.1.1.1 00012.3.4.5", "4111 1111 1111 1111, 4111-1111-1111-1112", "+49 (30) 123-4567 .",
    "9" * 30000, "x" * 30000 + "@y.z", "+1" + "2 " * 5000 + "3", "é🎉 4111111111111111 bob@ex.com", "1.1.1.1" * 500, "call bob (at) example (dot) com",
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(9)
    texts = PII + ["".join(rng.choice("ab1234.@+-() ") for _ in range(60)) for _ in range(200)]
    docs = frame(spark, texts)
    model = pii.learn(docs)
    found = pii.with_spans(docs, model).select("doc_id", "text", pii.in_order(F.col("found")).alias("found"))
    rows = found.select("doc_id", "text", pii.joined(F.filter("found", lambda x: x["base"])).alias("base"), pii.joined(F.col("found")).alias("all"))
    for r in rows.collect():
        assert r.base == base_spans(texts[r.doc_id])
        assert set(r.base.split(",")) <= set(r.all.split(",")) | {""}
    cleaned = pii.redacted(docs, model)
    assert cleaned.columns == docs.columns
    clean = {r.doc_id: r.text for r in cleaned.collect()}
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert 6 <= plan.count("regexp_extract_all") <= 7  # one for each form
    assert clean[texts.index("a@b.c")] == "<EMAIL>" and clean[1] is None
    assert clean[texts.index("call bob (at) example (dot) com")] == "call <EMAIL>"


def test_supervision_prefers_labelers_that_agree():
    counts = [("phone", "11---", "size1|shapen|word", 80), ("phone", "-1-0-", "size1|shapes|word3", 5), ("card", "11---", "size2|shapes|word", 60), ("card", "00-0-", "size2|shapen|word9", 40), ("card", "01---", "size2|shapes|word", 10)]
    model = pii.supervise(counts)
    assert model.reliability["form"] > 0.8 and 0 < model.rate["card"] < 1
    assert model.weights["card"]["word9"] < 0 < model.weights["card"]["0:1"]
    assert pii.supervise([]).weights == {k: {} for k in pii.KINDS}


def test_estimates_equal_plain_expectation_maximisation():
    """One round over single spans, by Bayes' rule written out."""
    counts = [("phone", "11---", 3), ("phone", "0---0", 2), ("ip", "1-1--", 4)]
    acc, rate, posterior = pii.estimate(counts, 1)
    expected = {}
    for kind, votes, _ in counts:
        yes = no = 0.5
        for v in votes:
            yes *= {"1": 0.8, "0": 0.2, "-": 1}[v]
            no *= {"1": 0.2, "0": 0.8, "-": 1}[v]
        expected[kind, votes] = yes / (yes + no)
    assert posterior == pytest.approx(expected)
    spans = [(k, v) for k, v, n in counts for _ in range(n)]
    right = [expected[k, v] if v[0] == "1" else 1 - expected[k, v] for k, v in spans]
    assert acc["form"] == pytest.approx(min(0.98, max(0.55, (sum(right) / 9 + 0.08) / 1.1)))
    assert rate["phone"] == pytest.approx((sum(expected[k, v] for k, v in spans if k == "phone") / 9 + 0.05) / (5 / 9 + 0.1))


def test_personal_data_of_an_empty_table(spark):
    model = pii.learn(empty(spark))
    assert pii.with_spans(empty(spark), model).count() == pii.redacted(empty(spark), model).count() == 0
    clash = spark.createDataFrame([(1, "mail me: a@b.cc", "x", 2)], "doc_id long, text string, found2 string, _id long")
    assert pii.redacted(clash, model).collect() == [(1, "mail me: <EMAIL>", "x", 2)]


# -- language ---------------------------------------------------------------------------
def test_language_held_out(spark):
    rng = random.Random(2)
    parts = {"xx": "ba be bi bo bu la le".split(), "yy": "zor kra vut tsch grm".split(), "zz": "ñé óa çá êi".split()}
    rows = []
    for k in range(360):
        lang = ["xx", "yy", "zz"][k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(8, 120))), lang))
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "123 ...", "xx"), (902, "", None)], "doc_id long, text string, lang string")
    net = langid.learn(docs.where("doc_id % 4 <> 2"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs, net).collect()}
    held = [(got[k][0], lang) for k, _, lang in rows if k % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert got[900] == got[901] == got[902] == ("und", 1.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.learn(empty(spark)) is None
    assert langid.identified(docs.limit(1), None).first().lang_pred == "und"


def test_folded_tables_equal_direct_convolution():
    rng = np.random.default_rng(5)
    sizes = [(w, langid.EMBED, langid.FILTERS) for w in langid.WIDTHS]
    n = len(sizes) * langid.FILTERS
    net = langid.Network(["a", "b", "c"], rng.normal(size=(256, langid.EMBED)), [rng.normal(size=x) for x in sizes], rng.normal(size=n), rng.normal(size=(n, 3)), rng.normal(size=3))
    windows = rng.integers(0, 256, (9, langid.WINDOW)).astype(np.uint8)
    got = net.probabilities(windows, net.tables())
    for window, row in zip(windows, got, strict=True):
        pooled = []
        for f in net.filters:
            for c in range(langid.FILTERS):
                pooled.append(max(sum(float(net.embed[window[at + j]] @ f[j, :, c]) for j in range(len(f))) for at in range(langid.WINDOW - len(f) + 1)))
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        assert row == pytest.approx(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), rel=1e-4)


def test_windows_hold_every_byte():
    texts = [b"", b"x", b"y" * langid.WINDOW, bytes(range(256)) * 9]
    windows, owner, held = langid.windows_of(texts)
    for k, text in enumerate(texts):
        assert b"".join(w.tobytes()[:n] for w, o, n in zip(windows, owner, held, strict=True) if o == k) == text


# -- decontamination ---------------------------------------------------------------------------
def brute_tiles(p, t, least):
    free_p, free_t, tiles = [True] * len(p), [True] * len(t), []
    while True:
        best, top = [], least - 1
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and free_p[i + k] and free_t[j + k] and t[j + k] >= 0:
                    k += 1
                if k > top:
                    top, best = k, [(i, j, k)]
                elif k == top and k >= least:
                    best.append((i, j, k))
        if not best:
            return tiles
        for i, j, k in best:
            if all(free_p[i : i + k]) and all(free_t[j : j + k]):
                free_p[i : i + k] = free_t[j : j + k] = [False] * k
                tiles.append((i, j, k))


def test_tiling_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        p, t = [rng.randint(0, 3) for _ in range(rng.randint(3, 25))], [rng.randint(-1, 3) for _ in range(rng.randint(3, 40))]
        assert sum(x[2] for x in decontam.tile(p, t, 3)) == sum(x[2] for x in brute_tiles(p, t, 3))


def test_tiling_of_repeated_tokens_takes_linear_time():
    began = time.time()
    assert decontam.tile([1] * 1000, [1] * 100_000, 5) == [(0, 0, 1000)]
    assert sum(x[2] for x in decontam.tile([1] * 1000, ([1] * 999 + [-1]) * 100, 5)) == 999
    assert sum(x[2] for x in decontam.tile([1, 2] * 500, ([1, 2] * 6 + [3]) * 8000, 5)) >= 990
    assert time.time() - began < 20


def test_items_that_share_runs(spark):
    common = " ".join(f"c{k}" for k in range(12))
    items = [(f"i{k}", f"{common} {' '.join(f'x{k}y{j}' for j in range(6))}", 1) for k in range(300)] * 2 + [(None, common, 1)]
    bench = spark.createDataFrame(items, "item_id string, text string, doc_id long")
    docs = spark.createDataFrame([(1, f"{common} " * 300, "z"), (1, f"{common} " * 300, "z"), (None, common, "z"), (3, "c0 c1 c2 c3 c4", "z")], "doc_id long, text string, item_id string")
    found = decontam.contaminated(docs, bench).collect()
    assert len(found) == 3 * 301 and {(r.covered, r.item_tokens) for r in found} == {(12, 18), (12, 12)}
    assert [r.doc_id for r in decontam.decontaminated(docs, bench).collect()] == [3]


def test_contamination(spark):
    words = [f"w{k}" for k in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[30:])), (3, "too short"), (4, None)], "item_id long, text string")
    noise = " ".join(f"n{k}" for k in range(400))
    texts = [
        noise,
        f"{noise} {' '.join(words[:30])} {noise}",
        f"{' '.join(words[15:30])} {noise} {' '.join(words[:15])}".upper(),
        f"{noise} {' '.join(words[:10])}",
        " ".join(words),
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in decontam.contaminated(docs, items).collect()}
    assert found == {(1, 1): (30, 1), (2, 1): (30, 2), (4, 1): (30, 1), (4, 2): (30, 1)}
    assert sorted(r.doc_id for r in decontam.decontaminated(docs, items).collect()) == [0, 3, 5, 6]
    assert decontam.contaminated(docs, items.limit(0)).count() == decontam.contaminated(docs.limit(0), items).count() == 0


# -- toxicity ------------------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["grumble" + s for s in ("x", "on", "ity", "s")] + ["nasty"]
    rows = []
    for k in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        toxic = int(k % 6 == 0)
        for _ in range(rng.randint(2, 6) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), toxic))
    grammar = toxicity.learn([r for r in rows if r[0] % 3 != 1])
    held = [(grammar.score(t), y) for k, t, y in rows if k % 3 == 1]
    assert all((s >= 0.7) == (y == 1) for s, y in held)
    docs = frame(spark, ODD)
    assert all(0 <= r.score < 0.7 for r in toxicity.scored(docs, grammar).collect())
    assert toxicity.accepted(docs, grammar).columns == docs.columns
    assert toxicity.accepted(docs, grammar).count() == len(ODD) + 1
    assert toxicity.learn([]).score("anything") < 0.01


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"scum": 3.0}, {}, -1.0, (1.0,) * 7)
    channel = lambda text: {c for c, v in zip(toxicity.CHANNELS, g.features(text), strict=False) if v}
    assert channel("what scum") == {"plain"}
    assert channel("you are scum") == {"at_target"}
    assert channel("you are not scum") == {"negated"}
    assert channel("he said scum") == {"reported"}
    assert g.features("scummy weather, no match") is None


def brute_channels(read):
    """What a clause writes, by the rules themselves."""
    out = Counter()
    has_target = any(x == "t" for x, _ in read)
    for k, (x, w) in enumerate(read):
        if x not in "ik":
            continue
        before = read[:k]
        words = [y for y, _ in before if y != "q"]
        negated = "n" in words[-toxicity.REACH :]
        reported = any(y == "r" for y, _ in before) or sum(y == "q" for y, _ in before) % 2 == 1
        out["negated" if negated else "reported" if reported else "at_target" if has_target else "plain"] += w
    return dict(out)


def test_clause_machine_equals_rules_and_paths():
    rng = random.Random(12)
    m = toxicity.clause_machine()
    for _ in range(400):
        read = [(x, float(rng.randint(1, 9)) if x in "ik" else 0.0) for x in rng.choices(toxicity.SYMBOLS, k=rng.randint(0, 12))]
        got = m.run(read)
        assert got == brute_channels(read)
        paths = list(m.paths([x for x, _ in read]))
        assert len(paths) == 1  # unambiguous
        sums = Counter()
        for (out, w), (_, value) in zip(paths[0], read, strict=True):
            if value:
                sums[out] += w * value
        assert dict(sums) == got


def test_composition_equals_feeding_one_machine_to_the_other():
    rng = random.Random(3)
    def some(read, written):
        return transducers.machine([0, 1], [1, 2], [(rng.randrange(3), rng.choice(read), rng.randrange(3), rng.choice(written), rng.randint(1, 5)) for _ in range(14)])
    for _ in range(40):
        a, b = some("xy", "uv"), some("uv", "pq")
        for _ in range(5):
            text = rng.choices("xy", k=4)
            fed = sorted((tuple(o for o, _ in q), tuple(w * v for (_, w), (_, v) in zip(p, q, strict=True))) for p in a.paths(text) for q in b.paths([o for o, _ in p]))
            assert sorted((tuple(o for o, _ in p), tuple(w for _, w in p)) for p in a.compose(b).numbered().paths(text)) == fed


# -- urls ------------------------------------------------------------------------------------------
def test_url_rules_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "x.net", "", "com."]
    paths = ["", "/", "/en", "/en/", "/en/x", "/fr/", "/en/x/y"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:6] for p in paths[:5] if rng.random() < 0.6]
    pages = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f'])}" for _ in range(300)] + [None, "", "no-scheme/x", "HTTP://WWW.Example.COM/EN/"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    merged = {}
    for h, p, v in rules:
        merged[h, p] = "block" if "block" in (v, merged.get((h, p))) else v
    for r in urls.judged(df, table).collect():
        url = pages[r.page_id] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in merged.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (max(fit)[2:] if fit else (None, "allow"))


def test_url_rules_of_equal_length_in_blocks(spark, monkeypatch):
    """Some rules are of one length for an url, with hosts of different length; a block each, and one for all."""
    rules = [(f"m{k}.com", "/ab", "block") for k in range(14)] + [(f"b.m{k}.com", "/", "allow") for k in range(14)] + [("m0.com", "/ab", "allow")]
    pages = [(k, f"http://b.m{k}.com/ab") for k in range(14)] + [(20, "http://b.m1.com/ab"), (21, None), (None, "http://m1.com/abc")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    whole = sorted(map(tuple, urls.judged(df, table).collect()), key=str)
    assert {r[4] for r in whole} == {f"b.m{k}.com/" for k in range(14)} | {"m1.com/ab", None}
    for most in (1, 5):
        monkeypatch.setattr(urls, "MOST_RULES", most)
        assert sorted(map(tuple, urls.judged(df, table).collect()), key=str) == whole
    assert urls.judged(df.limit(0), table).count() == 0
    assert {r.verdict for r in urls.judged(df, table.limit(0)).collect()} == {"allow"}


def test_url_rules_in_blocks(spark, monkeypatch):
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/x", "block"), ("net", "/", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://b.a.com/xy"), (1, "http://b.a.com/xy"), (2, "http://q.org/")], "page_id long, url string")
    whole = sorted(map(tuple, urls.judged(df, rules).collect()), key=str)
    monkeypatch.setattr(urls, "MOST_RULES", 1)
    assert sorted(map(tuple, urls.judged(df, rules).collect()), key=str) == whole


# -- html ------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies. Accept them all, please, thank you very much indeed.</p></div><div class="%s"><h1>Title &amp; more</h1><p>First   block, with <b>bold &lt;text&gt;
and a line.<br>After the break. <p>Second block &eacute;&#8212;x is long enough to count as text of an article.</p></div>
<aside><p>Sidebar words that are long enough to look like text, maybe.</p></aside><section id="comments"><p>A reader comment that is fairly long. It has sentences. Many of them.</p></section>
<form><p>Subscribe now to read more of our stories every week.</p></form><footer><p>Copyright</p></footer></body></html>"""
TEXT = "Title & more\n\nFirst block, with bold <text> and a line. After the break.\n\nSecond block é—x is long enough to count as text of an article."


def test_main_text(spark):
    rows = [(k, f"http://h{k % 2}.example/p{k}", PAGE % ("story" if k % 2 else "entry x1")) for k in range(8)]
    rows += [(100, "http://h0.example/e", ""), (101, None, None), (102, "http://h9.example/", "<p>loose text only"), (103, "u", "<nav>menu</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(df).collect()}
    assert all(got[k] == TEXT for k in range(8))
    assert (got[100], got[101], got[102], got[103]) == ("", "", "loose text only", "")
    assert {r.host: r.paths for r in htmltext.host_paths(df).collect()}["h0.example"] == ["html/body/div.entry.x"]
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_article_parts_that_are_no_furniture():
    text = "<p>Words of the article stand here, and there are quite a few of them. More follow.</p>"
    page = f"<body><div class='site-header'><p>Site</p></div><div class='print-article'>{text}</div><div class='article-comments'>{text}</div><div class='related-posts'><p>Other</p></div></body>"
    assert htmltext.extract(page, []) == "Words of the article stand here, and there are quite a few of them. More follow."
    page = f"<article><header><h1>Title</h1></header>{text}<div class='related-work'>{text}</div><fieldset><p>In a set.</p></fieldset><header><p>Gone</p></header><footer>Gone</footer></article>"
    assert htmltext.extract(page, []).split("\n\n") == ["Title", *["Words of the article stand here, and there are quite a few of them. More follow."] * 2, "In a set."]


def test_furniture_words():
    yes = "ad ads ad-slot cookie-banner site-footer footer-copyright post-comments userComment comment-text disqus_thread share-buttons social-media related-posts sponsored-post menu-toggle sidebar sidebar-primary mainNav newsletter-signup promo-box"
    no = "article main content print-article related-work has-sidebar no-footer side-effects post entry-content research-paper headers shared adhoc navel newsletter-article body text"
    assert [w for w in yes.split() if not htmltext.is_furniture(w)] == [] and [w for w in no.split() if htmltext.is_furniture(w)] == []


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "a word. " * 9, "<b>" * 100_000 + "a word." + "</i>" * 100_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "w" + "<p>x</p>" * 50_000, "<li>" * 100_000 + "end", "<" * 100_000, '<a "' * 50_000])
def test_nested_and_stray_tags_take_linear_time(source):
    began = time.time()
    path = htmltext.vote(source)
    assert htmltext.extract(source, [path] if path else []) == htmltext.extract(source, [])
    assert time.time() - began < 20


def test_scores_equal_those_of_each_container_alone():
    """Sums from the inside out are what measuring every container by itself gives."""
    rng = random.Random(4)
    for _ in range(200):
        source = "".join(rng.choice(["<div>", "</div>", "<p>", "<section class='entry-x'>", "</section>", "<a>Linked words. </a>", "<aside>", "</aside>", "Some words. ", "a much longer text that has more than forty characters! "]) for _ in range(60))
        root = htmltext.parse(source)
        for score, node in htmltext.scores(root):
            own = sum((len(t) - min(len(t), 2 * k)) * (1.0 if len(t) >= 40 else 0.6) + 15 * sum(t.count(c) for c in ".!?") for t, k, _ in htmltext.blocks(node))
            weight = {"#": 0.8}.get(node.tag, 1.0) * (1.15 if "entry" in node.name else 1.0)
            assert score == pytest.approx(own * weight)


def test_main_text_with_many_winners(spark, monkeypatch):
    df = spark.createDataFrame([(k, "http://h.example/", PAGE % "story") for k in range(5)], "page_id long, url string, html string")
    monkeypatch.setattr(htmltext, "MOST_WINNERS", 0)
    assert {r.text for r in htmltext.main_text(df).collect()} == {TEXT}


# -- quality -----------------------------------------------------------------------------------------
def brute_signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    marked = {k + j for k in range(len(words) - 7) if runs[tuple(words[k : k + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_signals_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [*ODD, "\x1c a\x85b c", "a " * 40, "a b c d e f g h a b c d e f g h", "x\nx\n \n x\n"] + ["".join(rng.choice("ab \n\t#") for _ in range(300)) for _ in range(200)]
    for t in texts:
        assert quality.signals_of(t or "")[:5] == brute_signals(t)
    rows = quality.judged(frame(spark, texts)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judged(empty(spark)).count() == 0


def test_posterior_needs_more_than_one_bad_vote():
    counts = [("1" * 9, 900), ("110" + "1" * 6, 20), ("110110110", 60), ("111001101", 60)]
    model = quality.estimate(counts, 9)
    assert model.evidence("1" * 9) > 0 > model.evidence("110110110")


def test_quality_estimate_equals_plain_expectation_maximisation():
    """One round over single texts, by Bayes' rule written out."""
    counts = [("11", 5), ("1-", 3), ("00", 2), ("-0", 4)]
    texts = [v for v, n in counts for _ in range(n)]
    odds = {v: 0.02 + 0.96 * (1 + v.count("1")) / (2 + v.count("1") + 4 * v.count("0")) for v in texts}
    start = ({"1": 0.7, "0": 0.05, "-": 0.25}, {"1": 0.3, "0": 0.4, "-": 0.3})
    model = quality.estimate(counts, 2, 1)
    assert model.prior == pytest.approx(min(0.98, max(0.5, sum(odds[v] for v in texts) / len(texts))))
    for k in range(2):
        for side in (0, 1):
            share = lambda v: odds[v] if side == 0 else 1 - odds[v]  # noqa: B023, E731
            mass = sum(share(v) for v in texts) / len(texts)
            for x in "10-":
                got = sum(share(v) for v in texts if v[k] == x) / len(texts)
                assert model.chances[k][side][x] == pytest.approx((got + 0.01 * start[side][x]) / (mass + 0.01))
    z = math.log(model.prior / (1 - model.prior)) + math.log(model.chances[0][0]["1"] / model.chances[0][1]["1"]) + math.log(model.chances[1][0]["-"] / model.chances[1][1]["-"])
    assert model.evidence("1-") == pytest.approx(z)


def test_signals_know_other_scripts():
    names = quality.SIGNALS
    got = dict(zip(names, quality.signals_of("ПРИВЕТ мир 。\n日本語です。\n🎉🎉 ???"), strict=True))
    assert got["n_ending"] == 3 and got["n_alpha_words"] == 3 and got["n_upper_words"] == 1


def test_operators_take_clashing_columns_and_empty_tables(spark):
    """Extra columns with names that the operators use, nulls everywhere, and no rows."""
    clash = spark.createDataFrame([(1, "Some words stand here.", "x", "y", 0.5, None), (None, None, None, None, None, None)], "doc_id long, text string, score string, lang string, lang_pred double, n_words long")
    grammar = toxicity.learn([])
    for docs in (clash, clash.limit(0)):
        n = docs.count()
        assert toxicity.scored(docs, grammar).count() == toxicity.accepted(docs, grammar).count() == n
        assert langid.identified(docs, None).count() == quality.judged(docs).count() == n
        assert decontam.contaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    pages = spark.createDataFrame([(1, None, None, "h"), (1, None, None, "h"), (None, "http://h/", "<p>t</p>", "h")], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame([("h", "/", "block")], "host string, path string, verdict string")
    for table in (pages, pages.limit(0)):
        assert urls.judged(table, rules).count() == htmltext.main_text(table).count() == table.count()
    assert toxicity.train(clash.limit(0).withColumn("toxic", F.lit(1))).bias < 0


def test_digest_is_of_joined_ids(spark):
    row = spark.createDataFrame([([1, 22],), ([],)], "ids array<int>").select(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)).collect()
    assert [r[0] for r in row] == [hashlib.sha256(b"1,22").hexdigest(), hashlib.sha256(b"").hexdigest()]
    assert json.dumps([r[0] for r in row])

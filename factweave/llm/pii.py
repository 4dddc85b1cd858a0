"""Personal data by weak supervision, in DataFrame functions only.

Candidates.  Regular expressions find e-mail addresses, IP addresses, card numbers and phone numbers: strict ones (the
base spans, which always stay) and looser ones (spelled-out addresses, local phone numbers, numbers of card length that
fail the check digit).  Positions come from the matches and the stretches between them, so each expression
runs at most twice a text, and the second time only where it matched.

Supervision.  Labelers vote for (1), against (0) or abstain (-): the form itself, gazetteers (domain endings, issuer
digits, calling codes, reserved networks), cue words before the match, and degenerate digits.  Only counts by kind, votes and features leave the cluster, a bounded number whatever the corpus; expectation-maximisation on the votes estimates
each labeler's reliability and each kind's rate.  A logistic classifier of each kind over votes and span features (length class, shape,
hashed word before the span) is trained on the posteriors.
Loose spans that it accepts and that no base span of the kind overlaps are added.

Defined results: null texts count as empty and have no spans; positions are code points, end exclusive; a digit group
above the limits, a failing check digit or a wrong number of digits drops a strict match without retry; rows that repeat
keep their own results, an empty table gives no rows, and other columns are carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import small_rows

KINDS = ("email", "ip", "card", "phone")
#: Possessive groups don't recurse and lookbehinds start a run once, so long runs cost linear time.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}+(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[a-z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9.+(-])(?<![0-9] )\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])(?! [0-9])",
}
#: What a text must hold before an expression is tried on it.
NEEDS = {"email": "@", "phone": "+"}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|be|pl|us|ca|au|jp|br|mx|ar|in"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CUES = {
    "email": "mail|contact|write|reach|kontakt|schreib|correo|courriel|contacto",
    "ip": r"\bip\b|host|server|address|client|from|adresse|dirección",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "tel|phone|call|mobile|fax|contact|anruf|téléphone|teléfono|llam",
}
AGAINST = r"version|\bv\.?$|isbn|issn|doi|order|invoice|token|serial|\bid\b|artikel|page|§|chapter"
LABELERS = ("form", "gazetteer", "cue", "against", "digits")
#: Hash buckets of the word before a span; patterns of votes and features there can be at most.
WORD_BUCKETS = 32
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * 4 * 5 * (WORD_BUCKETS + 1)


_SPOTS = "array<struct<start:int,end:int,hit:string,pre:string>>"


def _placed(hits: Column, gaps: Column) -> Column:
    """array<struct<start, end, hit, pre>> from the matches of a pattern and the stretches between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPOTS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        found = F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(24)).alias("pre"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    both = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    return F.when(F.size(hits) > 0, F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPOTS))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _strict_ok(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(IP)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _votes(kind: str, form: Column, hit: Column, pre: Column) -> Column:
    """One character a labeler: 1, 0 or -."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    gazetteer = {
        "email": F.when(hit.rlike(rf"(?i)[.)\]] ?(?:{ENDINGS})$"), "1").otherwise("-"),
        "ip": F.when(hit.rlike(r"^(?:0|127|255)\."), "0").otherwise("1"),
        "card": F.when(digits.rlike("^(?:3[4-7]|4|5[1-5]|6(?:011|4|5))"), "1").otherwise("0"),
        "phone": F.when(hit.startswith("+"), F.when(digits.rlike(f"^(?:{CALLING})"), "1").otherwise("0")).otherwise("-"),
    }[kind]
    lower = F.lower(pre)
    cue = F.when(lower.rlike(CUES[kind]), "1").otherwise("-")
    against = F.when(lower.rlike(AGAINST), "0").otherwise("-")
    same = F.when(digits.rlike(r"^([0-9])\1+$") | digits.rlike("^0?123456"), "0").otherwise("-") if kind in ("card", "phone") else F.lit("-")
    return F.concat(form, gazetteer, cue, against, same)


def _features(hit: Column, pre: Column) -> Column:
    """What the final classifier sees of a span besides the votes: length class, shape, and the word before it by hash."""
    size = F.least(F.lit(3), F.floor(F.length(hit) / 8)).cast("string")
    shape = F.when(hit.rlike(r"[()\[\]]"), "b").when(hit.rlike(r"\x20"), "s").when(hit.rlike("-"), "d").when(hit.rlike(r"\."), "p").otherwise("n")
    word = F.regexp_extract(F.lower(pre), r"([^\W\d_]+)[^\w]*$", 1)
    return F.concat_ws("|", F.concat(F.lit("size"), size), F.concat(F.lit("shape"), shape), F.concat(F.lit("word"), F.when(word == "", "").otherwise(F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("string"))))


def _judge(kind: str, strict: bool):
    """Function from a located match to a candidate with its votes and features."""

    def judged(x: Column) -> Column:
        ok = _strict_ok(kind, x["hit"]) if strict else F.lit(False)
        votes = _votes(kind, F.when(ok, "1").otherwise("0") if strict else F.lit("-"), x["hit"], x["pre"])
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), ok.alias("base"), votes.alias("votes"), _features(x["hit"], x["pre"]).alias("features"))

    return judged


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def with_candidates(docs: DataFrame, text_col: str = "text", out: str = "_candidates") -> DataFrame:
    """docs and array<struct<kind, start, end, base, votes, features>> of each text, by kind, base form first, and then start.

    Matches and stretches, places and candidates are columns one after another, so that each expression runs once a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    needs = {
        ("email", True): F.contains(text, F.lit("@")),
        ("ip", True): text.rlike(r"[0-9]\.[0-9]"),
        ("card", True): text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        ("phone", True): F.contains(text, F.lit("+")),
        ("email", False): text.rlike(r"(?i)[\[(] ?at ?[\])]"),
        ("phone", False): text.rlike(r"[0-9]\)?[ .-][0-9]{3}"),
    }
    forms = [(k, strict) for k in KINDS for strict in (True, False) if (k, strict) in needs]
    names = {f: f"_{f[0]}_{'strict' if f[1] else 'loose'}" for f in forms}
    pattern = lambda f: (STRICT if f[1] else LOOSE)[f[0]]
    none = F.array().cast("array<string>")
    carried = [F.col(f"`{c}`") for c in docs.columns]
    hits = [F.when(needs[f], F.regexp_extract_all(text, F.lit(pattern(f)), F.lit(0))).otherwise(none).alias(names[f] + "_hits") for f in forms]
    df = docs.select(*carried, *hits)
    gaps = [F.when(F.size(names[f] + "_hits") > 0, F.split(text, pattern(f), -1)).otherwise(none).alias(names[f] + "_gaps") for f in forms]
    df = df.select(*carried, *(names[f] + "_hits" for f in forms), *gaps)
    df = df.select(*carried, *(_placed(F.col(names[f] + "_hits"), F.col(names[f] + "_gaps")).alias(names[f]) for f in forms))
    parts = []
    for kind, strict in forms:
        found = F.col(names[kind, strict])
        if kind == "card":
            found = F.filter(found, lambda x: F.length(F.regexp_replace(x["hit"], "[^0-9]", "")).between(13, 19))
        found = F.transform(found, _judge(kind, strict))
        if strict and kind != "card":  # a failed check digit may still be a card; other failures are no candidates
            found = F.filter(found, lambda x: x["base"])
        parts.append(found)
    return df.select(*carried, F.concat(*parts).alias(out))


@dataclass
class Supervision:
    """What the votes taught: reliabilities, rates by kind, and the final classifier's weights by kind and feature."""

    reliability: dict[str, float] = field(default_factory=dict)
    rate: dict[str, float] = field(default_factory=dict)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    def score(self, span: Column) -> Column:
        """Probability of a candidate span: a logistic function of its kind's weights of votes and features."""
        z = F.lit(0.0)
        for kind in KINDS:
            own = self.weights.get(kind, {})
            total = F.lit(own.get("bias", 0.0))
            for k in range(len(LABELERS)):
                vote = F.substr(span["votes"], F.lit(k + 1), F.lit(1))
                total = total + F.when(vote == "1", F.lit(own.get(f"{k}:1", 0.0))).when(vote == "0", F.lit(own.get(f"{k}:0", 0.0))).otherwise(F.lit(0.0))
            known = {x: w for x, w in own.items() if x != "bias" and ":" not in x}
            if known:
                table = F.create_map(*(F.lit(y) for x, w in sorted(known.items()) for y in (x, w)))
                total = total + F.aggregate(F.split(span["features"], "[|]"), F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(table, x), F.lit(0.0)))
            z = F.when(span["kind"] == kind, total).otherwise(z)
        return 1.0 / (1.0 + F.exp(-z))


def supervise(counts: list[tuple[str, str, str, int]], rounds: int = 40) -> Supervision:
    """Expectation-maximisation over (kind, votes, features, count) patterns, then the classifier trained on the posteriors."""
    by_votes: dict[tuple[str, str], int] = {}
    for kind, votes, _, n in counts:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    acc, rate, posterior = estimate([(k, v, n) for (k, v), n in sorted(by_votes.items())], rounds)
    return Supervision(acc, rate, {k: fit([(v, f, n, posterior[k, v]) for x, v, f, n in counts if x == k]) for k in KINDS})


def estimate(counts: list[tuple[str, str, int]], rounds: int = 40) -> tuple[dict[str, float], dict[str, float], dict[tuple[str, str], float]]:
    """Reliability of each labeler, rate of each kind, and posterior of each (kind, votes)."""
    acc = dict.fromkeys(LABELERS, 0.8)
    rate = dict.fromkeys(KINDS, 0.5)
    posterior: dict[tuple[str, str], float] = {}
    scale = 1.0 / max(1, sum(n for _, _, n in counts))
    for _ in range(rounds):
        for kind, votes, _ in counts:
            z = math.log(rate[kind] / (1 - rate[kind]))
            for name, v in zip(LABELERS, votes, strict=True):
                if v != "-":
                    z += (1 if v == "1" else -1) * math.log(acc[name] / (1 - acc[name]))
            posterior[kind, votes] = 1 / (1 + math.exp(-z))
        for k, name in enumerate(LABELERS):
            hit = sum(n * scale * (posterior[kind, v] if v[k] == "1" else 1 - posterior[kind, v]) for kind, v, n in counts if v[k] != "-")
            all_ = sum(n * scale for _, v, n in counts if v[k] != "-")
            # A Beta prior worth a tenth of the candidates keeps a labeler better than chance and short of certain.
            acc[name] = min(0.98, max(0.55, (hit + 0.08) / (all_ + 0.1)))
        for kind in KINDS:
            all_ = sum(n * scale for x, _, n in counts if x == kind)
            rate[kind] = min(0.95, max(0.05, (sum(n * scale * posterior[kind, v] for x, v, n in counts if x == kind) + 0.05) / (all_ + 0.1)))
    return acc, rate, posterior


def fit(rows: list[tuple[str, str, int, float]], steps: int = 400, ridge: float = 1.0) -> dict[str, float]:
    """Logistic regression of the posteriors on votes and features of one kind; rows: votes, features, count, posterior."""
    if not rows:
        return {}
    names = ["bias", *sorted({x for v, f, _, _ in rows for x in _inputs(v, f)})]
    at = {x: k for k, x in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    x[:, 0] = 1
    for row, (votes, features, _, _) in enumerate(rows):
        x[row, [at[y] for y in _inputs(votes, features)]] = 1
    n, target = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows])
    n *= min(1.0, 10_000 / n.sum())  # the ridge keeps its say however large the corpus is
    w = np.zeros(len(names))
    penalty = np.full(len(names), ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - target)) + penalty * w
        hess = (x * (n * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(names, w.tolist(), strict=True))


def _inputs(votes: str, features: str) -> list[str]:
    return [*(f"{k}:{v}" for k, v in enumerate(votes) if v != "-"), *features.split("|")]


def learn(docs: DataFrame, text_col: str = "text") -> Supervision:
    """Patterns of votes and features of all documents, counted with map-side sums, and what they teach."""
    each = with_candidates(docs.select(text_col), text_col).select(F.explode("_candidates").alias("c"))
    counts = each.groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.features").alias("features")).agg(F.count("*").alias("n"))
    rows = small_rows(counts, PATTERNS, "patterns of votes and features")
    return supervise(sorted((r.kind, r.votes, r.features, r.n) for r in rows))


def with_spans(docs: DataFrame, model: Supervision, text_col: str = "text", out: str = "found", at_least: float = 0.5) -> DataFrame:
    """docs and array<struct<kind, start, end, base, score>>: the base spans, and accepted others that overlap none of their kind."""
    carried = [F.col(f"`{c}`") for c in docs.columns]
    df = with_candidates(docs, text_col)
    df = df.select(*carried, F.transform("_candidates", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), model.score(x).alias("score"))).alias("_scored"))
    df = df.select(*carried, "_scored", F.filter("_scored", lambda x: x["base"]).alias("_base"))
    free = F.filter("_scored", lambda x: ~x["base"] & (x["score"] >= at_least) & ~F.exists("_base", lambda b: (b["kind"] == x["kind"]) & (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return df.select(*carried, F.concat("_base", free).alias(out))


def in_order(found: Column) -> Column:
    """Spans by kind as in KINDS, then start."""
    return F.concat(*(F.array_sort(F.filter(found, of_kind(k)), lambda a, b: a["start"] - b["start"]) for k in KINDS))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, model: Supervision, text_col: str = "text") -> DataFrame:
    """docs with each span, or stretch of overlapping spans, of the text replaced by its kind in angle brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(f"`{text_col}`")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, x["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    df = with_spans(docs, model, text_col, "_found")
    ordered = F.array_sort("_found", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    clean = F.when(F.size("_found") > 0, whole).otherwise(text).alias(text_col)
    return df.select(*(clean if c == text_col else F.col(f"`{c}`") for c in docs.columns))

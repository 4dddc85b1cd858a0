"""Toxicity by a weighted finite-state pattern grammar over clauses.

Grammar.  A lexicon machine turns words into symbols with weights: insults (whole words and word beginnings, learned
from labels), threats, targets, negation, verbs of saying, quotation marks and other words.  Five transducers over these
symbols (insult and threat mark what can offend, negation, reported speech and target say how it stands) are composed
into one clause machine; it has a path for every clause, and writes each insult or threat with its weight to a channel: plain,
at a target, negated or reported.  The target machine guesses at the start of a clause whether a target will come, and
only the guess that comes true accepts, so words before their target count as well.
An Aho-Corasick pass over the whole text finds the words that can offend, and only their clauses are read.  A document's
score is a logistic function of what its clauses wrote, fitted on labels.

Learning uses a bounded sample of labelled rows (at most about `max_train` rows and `max_chars` characters, chosen by hash of the id); fitting of the final function
uses scores from a lexicon learned on the other half of the sample.

Defined results: null and empty texts score what a text without matches scores; with no labelled rows, or labels of one
kind only, every score is the share of label 1 (0 if there are none); rows that repeat keep their own scores, an empty
table gives no rows, and other columns of the tables don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import discard, map_batches, share_of_hash, stored, texts_of
from factweave.llm.shingles import shingle_hashes, word_hashes
from factweave.llm.transducers import Transducer, machine

WORD = re.compile(r"[^\W\d_]+")
TOKENS = re.compile(r"[^\W\d_]+|[\"“”«»]")
CLAUSE_END = re.compile(r"[.!?;:\n]")
#: Fixed word lists of the four closed classes.
NEGATION = "not never no isn aren wasn don doesn didn nicht kein keine nie pas jamais ne nunca jamás".split()
REPORT = "said says saying called calls wrote quoted claims alleged sagte sagt nannte dit disait appelle dijo dice llamó".split()
TARGET = "you your yours they them he she him her people everyone du dich dir ihr euch tu toi vous te tú usted ustedes vosotros".split()
THREAT = "kill hurt beat destroy burn shoot stab hang töten umbringen tuer frapper matar golpear".split()
#: Words after a negation that it reaches; letters of the shortest and longest word beginnings learned.
REACH, PREFIX = 3, range(4, 8)
#: A lexicon entry needs this many toxic training texts, this share of them, this log odds, and this excess in standard deviations.
MIN_TEXTS, MIN_SHARE, MIN_WEIGHT, MIN_Z = 4, 0.01, 1.2, 7.0
CHANNELS = ("plain", "at_target", "negated", "reported")
#: Symbols of a clause: insult, threat, target, negation, verb of saying, quotation mark, other word.
SYMBOLS = "iktnrqo"
QUOTES = frozenset("\"“”«»")


def clause_machine() -> Transducer:
    """Insult, threat, negation, reported speech and target machines, composed.  Symbol h stands for a word that can offend."""
    kinds = dict(insult="i", threat="k", target="t", negation="n", report="r", quote="q", other="o")
    offend = {kinds["insult"]: "h", kinds["threat"]: "h"}
    insult = machine([0], [0], [(0, x, 0, "h" if x == "i" else x, 1.0) for x in kinds.values()])
    threat = machine([0], [0], [(0, x, 0, offend.get(x, x), 1.0) for x in (*kinds.values(), "h") if x != "i"])
    # State: how many further words a negation reaches.
    rest = ["t", "r", "o"]
    negation = machine([0], range(REACH + 1), [
        *((k, "n", REACH, "n", 1.0) for k in range(REACH + 1)),
        *((k, x, max(0, k - 1), x, 1.0) for k in range(REACH + 1) for x in rest),
        *((k, "h", max(0, k - 1), "negated" if k else "h", 1.0) for k in range(REACH + 1)),
        *((k, "q", k, "q", 1.0) for k in range(REACH + 1)),
    ])
    # State: a verb of saying was read; inside quotation marks.
    states = [(said, inside) for said in (False, True) for inside in (False, True)]
    report = machine([(False, False)], states, [
        *(((s, q), x, (s, q), x, 1.0) for s, q in states for x in ("t", "n", "o", "negated")),
        *(((s, q), "r", (True, q), "r", 1.0) for s, q in states),
        *(((s, q), "q", (s, not q), "q", 1.0) for s, q in states),
        *(((s, q), "h", (s, q), "reported" if s or q else "h", 1.0) for s, q in states),
    ])
    # State: no target in the clause; one will come; one has come.
    target = machine(["none", "will", "has"][:2], ["none", "has"], [
        *((s, x, s, x, 1.0) for s in ("none", "will", "has") for x in ("n", "r", "q", "o", "negated", "reported")),
        ("none", "h", "none", "plain", 1.0), ("will", "h", "will", "at_target", 1.0), ("has", "h", "has", "at_target", 1.0),
        ("will", "t", "has", "t", 1.0), ("has", "t", "has", "t", 1.0),
    ])
    return insult.compose(threat).compose(negation).compose(report).compose(target).numbered()




@dataclass
class Grammar:
    """Weights of whole words and of word beginnings, and the coefficients of the final function."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    slopes: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        self.finder = ahocorasick.Automaton()
        for p in {*self.prefixes, *(w for w, x in self.words.items() if x > 0), *THREAT}:
            self.finder.add_word(p, len(p))
        self.finder.make_automaton()
        self.closed = {w: "n" for w in NEGATION} | {w: "r" for w in REPORT} | {w: "t" for w in TARGET}
        self.machine = clause_machine()

    def weight(self, word: str) -> float:
        """Lexicon transducer: a whole word's own weight, else that of its longest known beginning."""
        if word in self.words:
            return self.words[word]
        for n in range(min(len(word), PREFIX.stop), PREFIX.start - 1, -1):
            if word[:n] in self.prefixes:
                return self.prefixes[word[:n]]
        return 1.0 if word in THREAT else 0.0

    def symbols(self, clause: str) -> list[tuple[str, float]]:
        """Lexicon machine: symbol and weight of each word and quotation mark; only words that can offend weigh something."""
        out = []
        for m in TOKENS.finditer(clause):
            word = m[0]
            if word in QUOTES:
                out.append(("q", 0.0))
            elif (kind := self.closed.get(word)) is not None:
                out.append((kind, 0.0))
            elif (w := self.weight(word)) > 0:
                out.append(("k" if word in THREAT else "i", w))
            else:
                out.append(("o", 0.0))
        return out

    def clause(self, text: str, out: dict[str, float]) -> int:
        """Adds what the clause machine writes for a clause to the channels; returns the number of words that can offend."""
        read = self.symbols(text)
        for channel, w in self.machine.run(read).items():
            out[channel] += w
        return sum(w > 0 for _, w in read)

    def features(self, text: str) -> list[float] | None:
        """What the whole text emits; None if nothing in it can."""
        low = text.lower()
        channels = dict.fromkeys(CHANNELS, 0.0)
        found, done, seen = 0, -1, set()
        for end, size in self.finder.iter(low):
            start = end - size + 1
            if start < done or start > 0 and low[start - 1].isalpha():
                continue
            a = _before(low, start)
            ending = CLAUSE_END.search(low, end)
            done = ending.start() if ending else len(low)
            found += self.clause(low[a:done], channels)
            seen.add(low[start : end + 4])
        if not found:
            return None
        words = max(20.0, len(low) / 6.0)
        total = sum(channels.values())
        return [*(math.log1p(channels[c]) for c in CHANNELS), math.log1p(found), math.log1p(len(seen)), math.log1p(100.0 * total / words)]

    def score(self, text: str) -> float:
        x = self.features(text)
        z = self.bias + (sum(a * b for a, b in zip(self.slopes, x, strict=True)) if x and self.slopes else 0.0)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _before(text: str, at: int) -> int:
    """Start of the clause that holds position `at`."""
    return 1 + max(text.rfind(c, 0, at) for c in ".!?;:\n")


def learn_lexicon(rows: list[tuple[str, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and word beginnings that stand in toxic texts far more often than in others."""
    seen: list[Counter] = [Counter(), Counter()]
    sizes = [0, 0]
    for text, label in rows:
        sizes[label] += 1
        words = set(WORD.findall(text.lower()))
        units = {w[:n] + "*" for w in words for n in PREFIX if len(w) >= n}
        seen[label].update(words)
        seen[label].update(units)
    n0, n1 = sizes
    if not n0 or not n1:
        return {}, {}
    words: dict[str, float] = {}
    prefixes: dict[str, float] = {}
    share = n1 / (n0 + n1)
    for unit, k1 in seen[1].items():
        k0 = seen[0][unit]
        if k1 < max(MIN_TEXTS, MIN_SHARE * n1):
            continue
        weight = math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
        z = (k1 - (k0 + k1) * share) / math.sqrt((k0 + k1) * share * (1 - share))
        if weight >= MIN_WEIGHT and z >= MIN_Z:
            (prefixes if unit[-1] == "*" else words)[unit.rstrip("*")] = min(5.0, weight)
    # A whole word under a toxic beginning that itself is no sign of toxicity.
    for unit, k0 in seen[0].items():
        k1 = seen[1][unit]
        if unit[-1] != "*" and k0 >= MIN_TEXTS and unit not in words and k0 * n1 >= k1 * n0 and any(unit[:n] in prefixes for n in PREFIX):
            words[unit] = 0.0
    return words, prefixes


def fit(features: np.ndarray, labels: np.ndarray, steps: int = 50, ridge: float = 0.05) -> tuple[float, tuple[float, ...]]:
    """Logistic regression by projected Newton steps: no slope is negative, so more matches never lower a score."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - labels @ z + ridge * (v[1:] @ v[1:]) / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + ridge * np.concatenate(([0.0], w[1:]))
        free = (w > 0) | (grad < 0)
        free[0] = True
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        size = 1.0
        while size > 1e-6:
            to = w - size * step
            to[1:] = np.maximum(to[1:], 0)
            if loss(to) < now:
                break
            size /= 2
        if size <= 1e-6:
            break
        w, now = to, loss(to)
    return float(w[0]), tuple(float(v) for v in w[1:])


def different(rows: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Rows without near copies of earlier ones, so that a copied text counts once in the lexicon."""
    seen: set[tuple[int, ...]] = set()
    out = []
    for row in rows:
        hashes = np.unique(shingle_hashes(np.array(word_hashes(row[1]), np.uint64), 3))[:12].tolist()
        marks = [tuple(hashes[k : k + 4]) for k in (0, 4, 8)]
        if not any(m in seen for m in marks if m):
            out.append(row)
        seen.update(m for m in marks if m)
    return out


def learn(rows: list[tuple[int, str, int]]) -> Grammar:
    """Grammar from (id, text, label) rows."""
    labels = np.array([r[2] for r in rows], float)
    if not len(rows) or labels.min() == labels.max():
        share = labels.mean() if len(rows) else 0.0
        return Grammar(bias=30.0 if share else -30.0)
    rows = different(rows)
    labels = np.array([r[2] for r in rows], float)
    half = [hash_half(r[0]) for r in rows]
    x = np.zeros((len(rows), 7))
    for side in (0, 1):
        other = Grammar(*learn_lexicon([(t, y) for h, (_, t, y) in zip(half, rows, strict=True) if h != side]))
        for k, (_, text, _) in enumerate(rows):
            if half[k] == side:
                x[k] = other.features(text) or 0.0
    words, prefixes = learn_lexicon([(t, y) for _, t, y in rows])
    bias, slopes = fit(x, labels)
    return Grammar(words, prefixes, bias, slopes)


def hash_half(key: int) -> int:
    return (key * 0x9E3779B97F4A7C15 >> 40) & 1


def train(labelled: DataFrame, max_train: int = 6_000, max_chars: int = 64_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Grammar from a hash sample of about max_train rows of id, text and label (0 or 1), and about max_chars characters at most."""
    good = labelled.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    good = stored(good, "labelled")
    size = good.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    share = min(1.0, max_train / max(1, size.n), max_chars / max(1, size.chars or 0))
    sample = good.where(share_of_hash(F.col("id"), F.lit(share))) if share < 1 else good
    rows = sorted((r.id, r.text or "", r.label) for r in sample.collect())
    discard(good)
    return learn(rows)


def scored(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row's whole text; one narrow pass."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    parts = (grammar.words, grammar.prefixes, grammar.bias, grammar.slopes)
    cache: list[Grammar] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache.append(Grammar(*parts))
        scores = [cache[0].score(t) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, score double")


def accepted(docs: DataFrame, grammar: Grammar, below: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows that score `below` or more; all columns stay, and nothing is shuffled."""
    place = docs.columns.index(text_col)
    parts = (grammar.words, grammar.prefixes, grammar.bias, grammar.slopes)
    cache: list[Grammar] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache.append(Grammar(*parts))
        return batch.filter(pa.array([cache[0].score(t) < below for t in texts_of(batch.column(place))], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def with_text(labels: DataFrame, docs: DataFrame, keep: Column, max_train: int) -> DataFrame:
    """Labelled texts: labels are thinned to a bounded sample before the texts are joined to them."""
    few = labels.where(keep & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    n = few.count()
    if n > max_train:
        few = few.where(share_of_hash(F.col("doc_id"), F.lit(max_train / n)))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")

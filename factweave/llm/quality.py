"""Quality rules as weak supervision: rules vote keep or drop or abstain, and a posterior decides instead of all-must-pass.

Signals are measured once over the whole text in a narrow pass.  Rules turn signals into votes by expressions.  Only the
counts of vote patterns, at most 3 to the number of rules, reach the driver; there expectation-maximisation of a naive
Bayes model with two hidden classes (clean, poor) estimates for every rule how often it votes each way in each class.
Every text then gets the posterior probability of its pattern.

Defined results: null and empty texts have no words and all signals 0, so they fail the base rules.  Rows that repeat an id keep
their own results.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import map_batches, small_rows, stored, texts_of

SYMBOLS = re.compile(r"[#*$%&|<>]")
RUN = 8
#: Characters that end a sentence or a quotation, in several scripts.
ENDINGS = frozenset(".!?…:;\"'”’»)]。！？；：」』）؟۔।॥")
#: Signals of a text, all long.
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ending", "n_alpha_words", "n_upper_words", "top_word")


def repeat_words(words: list[bytes], run: int = RUN) -> int:
    """Words that lie in a run of `run` words found at least twice in the text, the first one included.

    Exact: runs are numbered by doubling, pairs first, then pairs of pairs.
    """
    n = len(words) - run + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    size = 1
    while size < run:
        _, ids = np.unique(ids[:-size] * (len(words) + 1) + ids[size:], return_inverse=True)
        size *= 2
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + run, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def signals_of(text: str) -> tuple[int, ...]:
    """The SIGNALS of one text.  Words are runs of anything but space and the controls 9 to 13."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return (0,) * len(SIGNALS)
    white = len(text) - len(text.translate(_NO_SPACE))
    seen: set[str] = set()
    dup = lines = ending = 0
    for line in text.split("\n"):
        body = line.strip(" \t\r\x0b\x0c")
        if not body:
            continue
        lines += 1
        ending += body[-1] in ENDINGS
        dup += line in seen
        seen.add(line)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    alpha = upper = 0
    for w, n in counts.items():
        if w.isascii():
            alpha += n if _LETTER.search(w) else 0
            upper += n if len(w) > 1 and w.isupper() else 0
        else:
            word = w.decode("utf-8", "replace")
            alpha += n if any(map(str.isalpha, word)) else 0
            upper += n if len(word) > 1 and word.isupper() else 0
    return (len(words), len(text) - white, len(SYMBOLS.findall(text)), dup, repeat_words(words), lines, ending, alpha, upper, max(counts.values()))


_NO_SPACE = dict.fromkeys(map(ord, " \t\n\r\x0b\x0c"))
_LETTER = re.compile(rb"[A-Za-z]")


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and SIGNALS of each row's whole text."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(signals_of, texts_of(batch.column(1))), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, *SIGNALS])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, " + ", ".join(f"{s} long" for s in SIGNALS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Votes: 1 keep, 0 drop, null abstain."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    vote = lambda keep, drop: F.when(drop, 0).when(keep, 1)
    share = lambda c: F.col(c) / n
    return {
        "length": vote(F.col("n_words").between(50, 50_000), F.col("n_words") < 20),
        "word_length": vote((F.col("word_chars") / n).between(3, 9), ~(F.col("word_chars") / n).between(2, 14)),
        "symbols": vote(share("n_symbols") < 0.05, share("n_symbols") > 0.3),
        "lines": vote(F.col("n_dup_lines") * 20 <= F.col("n_lines"), F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        "repeats": vote(share("n_repeat_words") < 0.1, share("n_repeat_words") > 0.3),
        "letters": vote(share("n_alpha_words") > 0.8, share("n_alpha_words") < 0.6),
        "endings": vote(F.col("n_ending") * 2 >= F.col("n_lines"), (F.col("n_ending") * 10 < F.col("n_lines")) & (F.col("n_lines") > 3)),
        "capitals": vote(share("n_upper_words") < 0.1, share("n_upper_words") > 0.5),
        "top_word": vote(share("top_word") < 0.15, (share("top_word") > 0.3) & (F.col("n_words") >= 20)),
    }


def votes() -> Column:
    """One character a rule: 1, 0 or -."""
    return F.concat(*(F.coalesce(v.cast("string"), F.lit("-")) for v in rules().values()))


@dataclass
class Model:
    """Prior of the clean class, and for each rule the chances of 1, 0 and - in the clean and in the poor class."""

    prior: float
    chances: list[tuple[dict[str, float], dict[str, float]]]

    def evidence(self, pattern: str) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(c[v] / p[v]) for v, (c, p) in zip(pattern, self.chances, strict=True))

    def posterior(self, pattern: Column) -> Column:
        """Probability of the clean class for a column of vote patterns."""
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, (c, p) in enumerate(self.chances):
            v = F.substr(pattern, F.lit(k + 1), F.lit(1))
            z = z + F.when(v == "1", math.log(c["1"] / p["1"])).when(v == "0", math.log(c["0"] / p["0"])).otherwise(math.log(c["-"] / p["-"]))
        return 1.0 / (1.0 + F.exp(-z))


def estimate(counts: list[tuple[str, int]], n_rules: int, rounds: int = 60) -> Model:
    """Expectation-maximisation, started from the majority of the votes."""
    total = max(1, sum(n for _, n in counts))
    odds = {v: 0.02 + 0.96 * (1 + v.count("1")) / (2 + v.count("1") + 4 * v.count("0")) for v, _ in counts}
    model = Model(0.8, [({"1": 0.7, "0": 0.05, "-": 0.25}, {"1": 0.3, "0": 0.4, "-": 0.3})] * n_rules)
    for _ in range(rounds):
        clean = sum(n * odds[v] for v, n in counts) / total
        chances = []
        for k in range(n_rules):
            sides = []
            # A prior worth a hundredth of the texts: rules are mostly right about both classes.
            for side, start in ((0, {"1": 0.7, "0": 0.05, "-": 0.25}), (1, {"1": 0.3, "0": 0.4, "-": 0.3})):
                got = dict.fromkeys("10-", 0.0)
                for v, n in counts:
                    got[v[k]] += n / total * (odds[v] if side == 0 else 1 - odds[v])
                mass = sum(got.values())
                sides.append({x: (got[x] + 0.01 * start[x]) / (mass + 0.01) for x in got})
            chances.append((sides[0], sides[1]))
        model = Model(min(0.98, max(0.5, clean)), chances)
        odds = {v: 1 / (1 + math.exp(-max(-30.0, min(30.0, model.evidence(v))))) for v, _ in counts}
    return model


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """Id, SIGNALS, base_failed, quality (posterior) and kept of each row."""
    measured = stored(signals(docs, id_col, text_col), "signals").withColumn("votes", votes())
    names = list(rules())
    counts = measured.groupBy("votes").agg(F.count("*").alias("n"))
    model = estimate(sorted((r.votes, r.n) for r in small_rows(counts, 3 ** len(names), "vote patterns")), len(names))
    out = measured.withColumn("quality", model.posterior(F.col("votes"))).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= at_least))

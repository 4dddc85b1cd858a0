"""URL rules by a sort-merge range join.

A rule (host, path) fits its host and all subdomains, for paths that start with its own.  Written with the labels of the
host reversed and each followed by a dot, a rule's host is a prefix of the hosts that it fits: an interval of keys.  Rules
and urls are sorted by key and swept once; a stack holds the rule hosts whose intervals are open at the place, outermost
first.  Inside a host, its paths are nested intervals too, found by binary search and links to the enclosing path.  The
longest fitting rule (host and path together, then host) decides.

The rule set is checked: up to `MOST_RULES` it is sent to every task.  Urls aren't shuffled, so no host can be hot: each
task's urls are sorted by key where they are, and one merge with the sorted rules runs through the whole partition.  A larger set is
cut into blocks of that size, each merged the same way, and the longest of the blocks' answers is taken by the same order.

Defined results: host and path of a null url, or one without ://, are empty; no rule fits an empty host.  Of rules with
equal host and path, block wins; two different rules of equal length never fit one url, unless their hosts differ in
length: then the longer host wins.  Rows that repeat keep their own results, rows with a null id too.  Empty pages give
no rows, no rules the default verdict.  Other columns of pages aren't carried.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import bounded

MOST_RULES = 200_000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    """Reversed labels, each followed by a dot."""
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


@dataclass
class HostRules:
    """The rules of one host, sorted by path; `outer` links each to the longest shorter one that it starts with."""

    key: str
    host: str
    paths: list[str] = field(default_factory=list)
    verdicts: list[str] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)

    def longest(self, path: str) -> int:
        """Index of the longest rule path that `path` starts with, or -1."""
        k = bisect.bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.outer[k]
        return k


def compiled(rules: list[tuple[str, str, str]]) -> list[HostRules]:
    """HostRules sorted by key; block wins over allow for the same host and path."""
    best: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        at = (host, path)
        best[at] = "block" if "block" in (verdict, best.get(at)) else verdict
    hosts: dict[str, HostRules] = {}
    for (host, path), verdict in sorted(best.items()):
        key = host_key(host)
        if not key:
            continue
        own = hosts.setdefault(key, HostRules(key, host))
        open_ = len(own.paths) - 1
        while open_ >= 0 and not path.startswith(own.paths[open_]):
            open_ = own.outer[open_]
        own.outer.append(open_)
        own.paths.append(path)
        own.verdicts.append(verdict)
    return [hosts[k] for k in sorted(hosts)]


class Merge:
    """One pass of sorted rules beside urls that come in the order of their host keys."""

    def __init__(self, rules: list[HostRules]):
        self.rules, self.at = rules, 0
        self.open: list[HostRules] = []  # rule hosts whose intervals hold the present key, outermost first

    def find(self, key: str, path: str) -> tuple[str, str, int] | None:
        """Rule text, verdict and length of the host of the longest fitting rule."""
        rules, open_ = self.rules, self.open
        while self.at < len(rules) and rules[self.at].key <= key:
            own = rules[self.at]
            while open_ and not own.key.startswith(open_[-1].key):
                open_.pop()
            open_.append(own)
            self.at += 1
        while open_ and not key.startswith(open_[-1].key):
            open_.pop()
        best, found = (-1, -1), None
        for own in open_:
            if (j := own.longest(path)) >= 0 and (size := (len(own.host) + len(own.paths[j]), len(own.host))) > best:
                best, found = size, (own.host + own.paths[j], own.verdicts[j], len(own.host))
        return found


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule (null if none fits) and verdict (the rule's, else `default`).

    rules: host, path, verdict (allow or block).
    """
    rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict in ('allow', 'block')")
    n = rules.count()
    blocks = -(-n // MOST_RULES) or 1
    host = host_of(F.col(url_col))
    base = pages.select(F.col(id_col), F.col(url_col).alias("url"), host.alias("host"), path_of(F.col(url_col)).alias("path"))
    swept = []
    for b in range(blocks):
        part = rules if blocks == 1 else rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == b)
        swept.append(_swept(base, compiled([tuple(r) for r in part.distinct().collect()]), id_col))
    if blocks == 1:
        found = swept[0]
    else:  # the row's own key keeps repeated rows apart from different ones; equal rows have equal answers
        row = [id_col, "url", "host", "path"]
        each = reduce(DataFrame.unionByName, [s.withColumn("block", F.lit(b)) for b, s in enumerate(swept)])
        size = F.struct(F.coalesce(F.length("rule"), F.lit(-1)), F.coalesce(F.col("host_size"), F.lit(-1)))
        whole = each.groupBy(*row).agg(F.max_by(F.struct("rule", "found"), size).alias("b"), F.sum(F.when(F.col("block") == 0, 1)).alias("times"))
        found = whole.select(*row, "b.rule", "b.found", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).drop("col")
    return found.select(id_col, "url", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))


def _swept(base: DataFrame, rules: list[HostRules], id_col: str) -> DataFrame:
    kind = base.select(id_col).schema[0].dataType.simpleString()
    shared = base.sparkSession.sparkContext.broadcast(rules)
    # Labels reversed, each with a dot; strings compare by UTF-8 bytes here, which is the order of code points in Python.
    key = F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit(".")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = Merge(shared.value)
        for batch in batches:
            found = [merge.find(k, p) for k, p in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            rule, verdict, size = (pa.array([f and f[n] for f in found], t) for n, t in enumerate((pa.string(), pa.string(), pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], rule, verdict, size], names=[id_col, "url", "host", "path", "rule", "found", "host_size"])

    bounded(base.sparkSession)
    return base.withColumn("host_key", key).sortWithinPartitions("host_key").mapInArrow(run, f"`{id_col}` {kind}, url string, host string, path string, rule string, found string, host_size int")

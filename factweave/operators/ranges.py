"""Range, as-of and longest-prefix joins.

All have an equality key besides the range, and ranges are listed in buckets as long as themselves, so that the join is a hash or
sort-merge join, a range of any length makes two rows at most, and the comparison is left for rows of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Up to so many ranges, Spark may broadcast them.  It guesses their size from that of the files, which may be a small part of it.
BROADCAST_ROWS = 100_000


def _levels(ranges: DataFrame, start: str, end: str) -> tuple[DataFrame, dict[int, int]]:
    """Ranges with their level `_l`, the binary digits of their length, so that 2 ** _l is no less than it, and how many are of each level that occurs (64 at most)."""
    marked = ranges.where(F.col(start) <= F.col(end)).withColumn("_l", F.length(F.bin((F.col(end) - F.col(start)).cast("long"))))
    return marked, dict(sorted(tuple(r) for r in marked.groupBy("_l").count().collect()))


def _bucket(at: str) -> Column:
    return F.expr(f"shiftright(cast(`{at}` as bigint), _l)")


def holding(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points joined to the ranges of their keys that may hold them (both ends inclusive); the caller compares places.

    A range is cut by buckets as long as itself, so it is listed in two at most however long it is; a point is listed
    once for each length class that occurs.  All columns of both sides must differ but for the keys.  Ranges beyond
    BROADCAST_ROWS are joined by sorting both sides.
    """
    marked, levels = _levels(ranges, start, end)
    listed = marked.withColumn("_b", F.explode(F.array_distinct(F.array(_bucket(start), _bucket(end)))))
    if sum(levels.values()) > BROADCAST_ROWS:
        listed = listed.hint("merge")
    spots = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("_b", _bucket(at))
    return spots.join(listed, [*keys, "_l", "_b"], how).drop("_l", "_b")


def innermost(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, ties: list[Column]) -> DataFrame:
    """Each point with the narrowest range of its key that holds it (both ends inclusive), or nulls."""
    joined = holding(points, ranges, [key], at, start, end, "left")
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    names = [c for c in ranges.columns if c != key]
    order = [t.alias(f"_{k}") for k, t in enumerate([F.col(start) - F.col(end), *ties])]
    best = F.max(F.when(inside, F.struct(*order, F.struct(*names).alias("_range"))))
    out = joined.groupBy(*points.columns).agg(best.alias("_best"))
    return out.select(*points.columns, *[F.col(f"_best._range.{n}").alias(n) for n in names])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it, or nulls.

    One sort by key and place over the union of both sides; no pairs are made.
    """
    marks = F.struct(F.col(right_at).alias("at"), *values)
    r = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), marks.alias("_mark"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    l_ = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_mark"].dataType).alias("_mark"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", *[F.col(f"_mark.{v}") for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l_).withColumn("_last", F.last("_mark", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def longest_prefix(names: DataFrame, prefixes: DataFrame, name: str, prefix: str, separator: str = ".") -> DataFrame:
    """Each name with the row of the longest prefix that ends at a separator or is the whole name, or nulls.

    A name is listed under each of its own prefixes, and the join is on equality.
    """
    parts = F.split(F.col(name), separator.replace(".", r"\."))
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    listed = names.withColumn(prefix, F.explode(own))
    values = [c for c in prefixes.columns if c != prefix]
    hit = listed.join(prefixes.withColumn("_hit", F.lit(True)), prefix, "left")
    best = F.max(F.when(F.col("_hit"), F.struct(F.length(prefix).alias("_n"), F.col(prefix), *values)))
    out = hit.groupBy(*names.columns).agg(best.alias("_b"))
    return out.select(*names.columns, F.col(f"_b.{prefix}").alias(prefix), *[F.col(f"_b.{v}").alias(v) for v in values])


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of half-open intervals (start, stop) and (r_start, r_stop) of one key that overlap, each once.

    Of a pair, the interval of the larger length class is listed in its own buckets, two at most, and the other one in the
    buckets of that class that it touches, two at most; the pair is made in the bucket where the later one begins.
    """
    class_of = lambda a, b: F.length(F.bin((F.col(b) - F.col(a) - 1).cast("long")))
    l_ = left.where("start < stop").withColumn("_own", class_of("start", "stop"))
    r = right.where("r_start < r_stop").withColumn("_r_own", class_of("r_start", "r_stop"))
    levels = sorted({x[0] for x in l_.select("_own").distinct().union(r.select("_r_own").distinct()).collect()})
    every = F.array(*map(F.lit, levels or [0]))
    touched = lambda a, b: F.explode(F.array_distinct(F.array(_bucket(a), F.expr(f"shiftright(cast(`{b}` as bigint) - 1, _l)"))))

    def listed(df: DataFrame, own: str, a: str, b: str) -> DataFrame:
        return df.withColumn("_l", F.explode(F.filter(every, lambda x: x >= F.col(own)))).withColumn("_b", touched(a, b))

    both = listed(l_, "_own", "start", "stop").join(listed(r, "_r_own", "r_start", "r_stop"), [key, "_l", "_b"])
    both = both.where((F.col("_l") == F.greatest("_own", "_r_own")) & (F.col("start") < F.col("r_stop")) & (F.col("r_start") < F.col("stop")))
    return both.where(F.col("_b") == F.expr("shiftright(cast(greatest(start, r_start) as bigint), _l)")).drop("_b", "_l", "_own", "_r_own")


def merged(intervals: DataFrame, key: str) -> DataFrame:
    """Disjoint sorted intervals of a key: touching and overlapping ones become one."""
    before = Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("start", "stop")
    fresh = F.when(F.coalesce(F.max("stop").over(before) >= F.col("start"), F.lit(False)), 0).otherwise(1)
    grouped = intervals.where("start < stop").withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(upto))
    return grouped.groupBy(key, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def suppressed(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings (file_path, line, rule) without those in a range (file_path, start, end, tags); null tags suppress all rules."""
    spots = findings.select("file_path", "line", "rule").distinct()
    given = ranges.select("file_path", F.col("start").alias("_start"), F.col("end").alias("_end"), "tags")
    hit = holding(spots, given, ["file_path"], "line", "_start", "_end").where(F.col("line").between(F.col("_start"), F.col("_end")))
    hit = hit.where(F.col("tags").isNull() | F.array_contains("tags", F.col("rule")))
    return findings.join(hit.select("file_path", "line", "rule").distinct(), ["file_path", "line", "rule"], "left_anti").select(findings.columns)


def translated(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """New line of each old line (file_path, line) after hunks (file_path, old_start, old_count, new_count); null if the line went."""
    h = hunks.withColumn("first", F.when(F.col("old_count") == 0, F.col("old_start") + 1).otherwise(F.col("old_start")))
    at = h.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("first", "old_count", "new_count"))).alias("hunks"))
    moved = lines.join(at, "file_path", "left")
    gone = F.exists("hunks", lambda x: (F.col("line") >= x["first"]) & (F.col("line") < x["first"] + x["old_count"]))
    shift = F.aggregate(F.filter("hunks", lambda x: x["first"] + x["old_count"] <= F.col("line")), F.lit(0).cast("long"), lambda a, x: a + x["new_count"] - x["old_count"])
    return moved.select("file_path", "line", F.when(F.col("hunks").isNull(), F.col("line")).when(~gone, F.col("line") + shift).alias("new_line"))


def touching(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings (file_path, line, end_line) whose span meets a changed interval (file_path, start, stop half open)."""
    spans = findings.select("file_path", "line", "end_line").distinct()
    left = spans.select("file_path", "line", "end_line", F.col("line").alias("start"), (F.col("end_line") + 1).alias("stop"))
    hit = overlapping(left, changed.select("file_path", F.col("start").alias("r_start"), F.col("stop").alias("r_stop")), "file_path")
    return findings.join(hit.select("file_path", "line", "end_line").distinct(), ["file_path", "line", "end_line"], "left_semi")


def endpoint_events(spans: DataFrame, events: DataFrame, roles: list[str]) -> DataFrame:
    """The event of each pattern span (span, file_path, start, stop): the one inside it whose role comes first in `roles`, then the last by ordinal.

    events: file_path, event_id, role, at, ordinal.
    """
    rank = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    marked = events.withColumn("_rank", rank).where("_rank > 0")
    inside = holding(marked, spans.withColumn("_last", F.col("stop") - 1), ["file_path"], "at", "start", "_last").where("at >= start and at < stop")
    best = F.max_by("event_id", F.struct(-F.col("_rank"), F.col("ordinal"), F.col("event_id")))
    return inside.groupBy("span").agg(best.alias("event_id"))


def locations(points: DataFrame, functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """file_path, at, func_qn, block_id: the narrowest function range that holds a line, then that function's narrowest block; ties to the higher id.

    functions: file_path, func_qn, line, end_line; blocks: file_path, func_qn, block_id, line, end_line.
    """
    held = innermost(points.select("file_path", "at").distinct(), functions, "file_path", "at", "line", "end_line", [F.col("func_qn")]).select("file_path", "at", "func_qn").where("func_qn is not null")
    keyed = held.withColumn("_k", F.struct("file_path", "func_qn"))
    own = blocks.select(F.struct("file_path", "func_qn").alias("_k"), "block_id", F.col("line").alias("b_line"), F.col("end_line").alias("b_end"))
    return innermost(keyed, own, "_k", "at", "b_line", "b_end", [F.col("block_id")]).select("file_path", "at", "func_qn", "block_id")

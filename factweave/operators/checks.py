"""Rule checks: composed queries whose rows become violations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import recursive

COLUMNS = ("rule", "severity", "file_path", "line", "col", "message")


def violations(found: DataFrame, rule: str, severity: str = "warning", message: str = "") -> DataFrame:
    """Rows of any query as violations, by column name; file may be called file_path or file."""
    have = set(found.columns)
    path = next((c for c in ("file_path", "file") if c in have), None)
    column = lambda name, default: F.col(name) if name in have else default
    return found.select(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        (F.col(path) if path else F.lit("")).alias("file_path"),
        column("line", F.lit(0)).cast("long").alias("line"),
        column("col", F.lit(0)).cast("long").alias("col"),
        column("message", F.lit(message)).alias("message"),
    )


def sql_check(spark: SparkSession, views: dict[str, DataFrame], text: str, **given) -> DataFrame:
    """A rule written as SQL over fact views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return violations(spark.sql(text), **given)


def custom_check(facts: DataFrame, check: Callable, schema: str, **given) -> DataFrame:
    """A rule written as a function from an iterator of pandas frames to one of frames."""
    return violations(facts.mapInPandas(check, schema), **given)


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found).select(*COLUMNS)


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy("file_path", "line", "col", "rule")


def duplicate_members(members: DataFrame) -> DataFrame:
    """Each member (cluster, file_path, line) of a cluster with its first other member."""
    key = F.struct("file_path", "line")
    ends = members.groupBy("cluster").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).where("n > 1")
    lows = members.join(ends, "cluster").where(key != F.col("first"))
    second = lows.groupBy("cluster").agg(F.min(key).alias("second"))
    out = members.join(ends, "cluster").join(second, "cluster")
    other = F.when(key == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return out.select("cluster", "file_path", "line", other["file_path"].alias("other_file"), other["line"].alias("other_line"))


def danger(call: DataFrame, high: int = 10, medium: int = 5) -> DataFrame:
    """Fan-out of each caller: number of different callees, and high or medium where there are many."""
    out = call.groupBy("caller_qn").agg(F.countDistinct("callee_qn").alias("fan_out"))
    return out.withColumn("danger", F.when(F.col("fan_out") >= high, "high").when(F.col("fan_out") >= medium, "medium").otherwise("low"))


def flow_violations(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """source and sink events joined by value edges (src, dst) on a path that meets no sanitizer event.

    sources, sinks, sanitizers: column node.  Sources travel with the frontier as a key, so all run in one loop.
    """
    clean = edges.join(sanitizers.select(F.col("node").alias("src")), "src", "left_anti").join(sanitizers.select(F.col("node").alias("dst")), "dst", "left_anti")
    starts = sources.join(sanitizers, "node", "left_anti").select(F.col("node").alias("source"), "node")
    reached = recursive.reachable(clean.select("src", "dst"), starts, carry=("source",))
    return reached.join(sinks.select("node").distinct(), "node").where("source <> node").select("source", F.col("node").alias("sink"))


def sequences(first: DataFrame, second: DataFrame, edges: DataFrame, blockers: DataFrame) -> DataFrame:
    """Pairs of steps in one function where a path of blocks without blockers leads from the first to the second.

    first, second: file_path, func_qn, block_id, line; edges: file_path, func_qn, from_block, to_block; blockers as steps.
    In the first block blockers count from the first line on, in the last one up to the second line, in between anywhere.
    Within one block the second step must not come earlier.
    """
    keys = ["file_path", "func_qn"]
    b = blockers.select(*keys, F.col("block_id").alias("bb"), F.col("line").alias("bl")).distinct()
    a = first.select(*keys, F.col("block_id").alias("b0"), F.col("line").alias("l0")).distinct()
    z = second.select(*keys, F.col("block_id").alias("b1"), F.col("line").alias("l1")).distinct()
    together = a.join(z, keys).where("b0 = b1 and l1 >= l0")
    between = (together.b0 == b.bb) & (b.bl >= together.l0) & (b.bl <= together.l1)
    same = together.join(b, [together[k] == b[k] for k in keys] + [between], "left_anti").select(*keys, "l0", "l1")
    open_a = a.join(b, [a[k] == b[k] for k in keys] + [a.b0 == b.bb, b.bl >= a.l0], "left_anti")
    open_z = z.join(b, [z[k] == b[k] for k in keys] + [z.b1 == b.bb, b.bl <= z.l1], "left_anti")
    # Blocks reached from the first step through blocks without blockers.
    ways = edges.select(*keys, F.col("from_block").alias("src"), F.col("to_block").alias("dst"))
    inner = ways.join(b.select(*keys, F.col("bb").alias("src")).distinct(), [*keys, "src"], "left_anti")
    start = open_a.select(*keys, "b0").distinct().join(ways, keys).where("src = b0").select(*keys, "b0", F.col("dst").alias("node"))
    per = inner.join(open_a.select(*keys, "b0").distinct(), keys).select(*keys, "b0", "src", "dst")
    reached = recursive.reachable(per, start, (*keys, "b0")).select(*keys, "b0", F.col("node").alias("b1"))
    across = open_a.join(reached, [*keys, "b0"]).join(open_z, [*keys, "b1"]).select(*keys, "l0", "l1")
    return same.unionByName(across).distinct().select(*keys, F.col("l0").alias("first_line"), F.col("l1").alias("last_line"))

"""What a change touches: project impact with its tests, graph walks, container mutations, context of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import names
from factweave.operators import recursive


def project_impact(call: DataFrame, symbol: DataFrame, changed: DataFrame, namespaces: DataFrame, max_depth: int = 10) -> DataFrame:
    """qn, file_path, namespace, is_test and level of every caller of the changed symbols (qn), by the calls of one namespace.

    Calls count within the namespace (file_path, namespace) of their file; level 0 is a direct caller.
    """
    ways = call.join(namespaces, "file_path").select("namespace", F.col("callee_qn").alias("src"), F.col("caller_qn").alias("dst"))
    seeds = ways.join(changed.select(F.col("qn").alias("src")), "src", "left_semi").select("namespace", F.col("dst").alias("node"))
    reached = recursive.reachable(ways, seeds, keys=("namespace",), most=max(0, max_depth - 1)).withColumnRenamed("node", "qn")
    places = symbol.select(F.col("qualified_name").alias("qn"), "file_path", "name")
    test = names.is_test_file(F.col("file_path")) | names.is_test_symbol(F.col("name"))
    return reached.join(changed.select("qn"), "qn", "left_anti").join(places, "qn").select("qn", "file_path", "namespace", F.coalesce(test, F.lit(False)).alias("is_test"), "level")


def projection(impact: DataFrame, output: str = "symbols") -> DataFrame:
    """Names of impacted symbols, or of the tests among them, or of their files."""
    if output == "symbols":
        return impact.select(F.col("qn").alias("value")).distinct()
    if output == "tests":
        return impact.where("is_test").select(F.col("qn").alias("value")).distinct()
    if output == "files":
        return impact.select(F.col("file_path").alias("value")).distinct()
    raise ValueError(f"not an output: {output}")


def walk(call: DataFrame, symbol: str, direction: str = "callees", depth: int | None = None) -> DataFrame:
    """caller_qn, callee_qn and level of the edges met on a walk from a symbol along callees, callers or both."""
    down, up = call.select(F.col("caller_qn").alias("src"), F.col("callee_qn").alias("dst")), call.select(F.col("callee_qn").alias("src"), F.col("caller_qn").alias("dst"))
    ways = {"callees": down, "callers": up, "both": down.union(up)}[direction].distinct()
    seed = call.sparkSession.createDataFrame([(symbol,)], "node string")
    met = recursive.reachable(ways, seed, most=None if depth is None else max(0, depth - 1))
    edges = call.select("caller_qn", "callee_qn").distinct()
    ends = {"callees": ["caller_qn"], "callers": ["callee_qn"], "both": ["caller_qn", "callee_qn"]}[direction]
    found = None
    for end in ends:
        part = edges.join(met.select(F.col("node").alias(end), "level"), end).select("caller_qn", "callee_qn", "level")
        found = part if found is None else found.union(part)
    return found.groupBy("caller_qn", "callee_qn").agg(F.min("level").alias("level"))


def dot(edges: DataFrame) -> DataFrame:
    """One line of DOT text for each edge (caller_qn, callee_qn)."""
    return edges.select(F.format_string('"%s" -> "%s";', "caller_qn", "callee_qn").alias("line"))


def container_mutations(calls: DataFrame, uses: DataFrame, methods: list[str] = ("append", "add", "extend", "insert", "update", "push")) -> DataFrame:
    """from_event, to_event: what is put into a container reaches the later uses of the same generation of it.

    calls: func_id, receiver, generation, method, ordinal, arg_event; uses: func_id, var, generation, ordinal, event.  A
    generation numbers the definitions of a variable, so a new container starts afresh.  Only the first later use is linked to each
    argument; uses are chained among themselves, so rows grow with the number of events and not with its square.
    """
    puts = calls.where(F.col("method").isin(list(methods))).select("func_id", F.col("receiver").alias("var"), "generation", "ordinal", F.col("arg_event").alias("event"), F.lit(0).alias("side"))
    every = puts.unionByName(uses.select("func_id", "var", "generation", "ordinal", "event", F.lit(1).alias("side")))


    later = Window.partitionBy("func_id", "var", "generation").orderBy("ordinal", "side", "event").rowsBetween(1, Window.unboundedFollowing)
    linked = every.withColumn("to_event", F.first(F.when(F.col("side") == 1, F.col("event")), ignorenulls=True).over(later))
    return linked.where("to_event is not null").select(F.col("event").alias("from_event"), "to_event").distinct()


def context(call: DataFrame, reference: DataFrame, symbol: DataFrame, high: int = 10, medium: int = 5) -> DataFrame:
    """Of each symbol: callers, callees, uses and the danger of changing it by the number of callers."""
    callers = call.groupBy(F.col("callee_qn").alias("qn")).agg(F.countDistinct("caller_qn").alias("n_callers"))
    callees = call.groupBy(F.col("caller_qn").alias("qn")).agg(F.countDistinct("callee_qn").alias("n_callees"))
    uses = reference.where("ref_kind not in ('definition', 'import')").groupBy(F.col("symbol_qn").alias("qn")).agg(F.count("*").alias("n_refs"))
    out = symbol.select(F.col("qualified_name").alias("qn")).distinct()
    for part in (callers, callees, uses):
        out = out.join(part, "qn", "left")
    out = out.fillna(0, ["n_callers", "n_callees", "n_refs"])
    return out.withColumn("danger", F.when(F.col("n_callers") >= high, "high").when(F.col("n_callers") >= medium, "medium").otherwise("low"))

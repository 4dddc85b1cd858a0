"""Filters, joins, anti joins and counts over fact relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(facts: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; None means any."""
    for column, value in equal.items():
        if value is not None:
            facts = facts.where(F.col(column) == value)
    return facts


def references(refs: DataFrame, symbol: str, writes_only: bool = False, reads_only: bool = False, calls_only: bool = False, definition: bool = True, imports: bool = True) -> DataFrame:
    """References of a symbol; the first kind flag that is set decides, else definitions and imports can be left out."""
    out = refs.where(F.col("symbol_qn") == symbol)
    if writes_only:
        return out.where("ref_kind = 'write'")
    if reads_only:
        return out.where("ref_kind = 'read'")
    if calls_only:
        return out.where("ref_kind = 'call'")
    return out.where(~F.col("ref_kind").isin([k for k, keep in (("definition", definition), ("import", imports)) if not keep] or [""]))


def graph_edges(call: DataFrame, file_path: str | None = None) -> DataFrame:
    return matching(call, file_path=file_path).select("caller_qn", "callee_qn").distinct()


def namespaced(facts: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Facts with the namespace of their file, to be carried as a key in later joins."""
    return facts.join(namespaces, "file_path")


def receiver_types(method_call: DataFrame, def_use: DataFrame, type_binding: DataFrame) -> DataFrame:
    """Types of method receivers: the call's receiver, defined in a block that the call uses, bound at that line."""
    uses = def_use.select("file_path", "func_qn", F.col("var_name").alias("receiver"), F.col("use_block").alias("block_id"), "def_line")
    types = type_binding.select("file_path", F.col("symbol_qn").alias("receiver"), F.col("line").alias("def_line"), "type_str")
    return (
        method_call.join(uses, ["file_path", "func_qn", "receiver", "block_id"])
        .join(types, ["file_path", "receiver", "def_line"])
        .select("file_path", "func_qn", "receiver", "method", "type_str")
        .distinct()
    )


def unreferenced(symbol: DataFrame, refs: DataFrame) -> DataFrame:
    """Symbols without any reference but their definition."""
    seen = refs.where("ref_kind <> 'definition'").select(F.col("symbol_qn").alias("qualified_name"))
    return symbol.join(seen, "qualified_name", "left_anti")


def unreferenced_without(symbol: DataFrame, call: DataFrame, refs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Symbols that stay unreferenced once callers in `excluded` (qn) don't count; a symbol no one calls lives by any reference."""
    callee = F.col("callee_qn").alias("qualified_name")
    called = call.select(callee).distinct()
    alive = call.join(excluded.select(F.col("qn").alias("caller_qn")), "caller_qn", "left_anti").select(callee)
    loose = refs.where("ref_kind <> 'definition'").select(F.col("symbol_qn").alias("qualified_name")).join(called, "qualified_name", "left_anti")
    return symbol.join(alive.union(loose).distinct(), "qualified_name", "left_anti").join(excluded.select(F.col("qn").alias("qualified_name")), "qualified_name", "left_anti")


def cascade_dead(call: DataFrame, deleted: DataFrame) -> DataFrame:
    """qn of callees of deleted symbols (qn) that nothing else calls; one level."""
    caller = deleted.select(F.col("qn").alias("caller_qn"))
    hit = call.join(caller, "caller_qn", "left_semi").select(F.col("callee_qn").alias("qn")).distinct()
    others = call.join(caller, "caller_qn", "left_anti").select(F.col("callee_qn").alias("qn"))
    return hit.join(others, "qn", "left_anti").join(deleted.select("qn"), "qn", "left_anti")


def isolated(symbol: DataFrame, call: DataFrame) -> DataFrame:
    """Symbols with no call in or out."""
    ends = call.select(F.col("caller_qn").alias("qualified_name")).union(call.select("callee_qn")).distinct()
    return symbol.join(ends, "qualified_name", "left_anti")


def name_counts(symbol: DataFrame) -> DataFrame:
    """How many qualified names share a short name."""
    return symbol.groupBy("name").agg(F.countDistinct("qualified_name").alias("n_symbols"))


def ambiguous(symbol: DataFrame) -> DataFrame:
    """Qualified names that stand more than once."""
    return symbol.groupBy("qualified_name").agg(F.count("*").alias("n")).where("n > 1")


def severity_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity").agg(F.count("*").alias("n"))


def def_use_pairs(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Each definition of a name with each use of it in the same function, whatever the flow between."""
    return defs.join(uses, ["file_path", "func_qn", "var_name"]).distinct()


def latest_by(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by the given order."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top(df: DataFrame, score: Column, ties: list[str], limit: int) -> DataFrame:
    """The best rows by score, then by the tie columns."""
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), *ties).limit(limit)


def first_nonempty(*frames: DataFrame) -> DataFrame:
    """The first of the frames that has rows."""
    for df in frames[:-1]:
        if not df.isEmpty():
            return df
    return frames[-1]


def flows(trace_flow: DataFrame, func: str | None = None, source: str | None = None, sink: str | None = None) -> DataFrame:
    """Flows of a function, from a variable, to a variable."""
    return matching(trace_flow, func_qn=func, source_var=source, sink_var=sink)


def with_type(type_binding: DataFrame, expression: str) -> DataFrame:
    """symbol_qn and type_str of bindings whose type matches an expression."""
    return type_binding.where(F.col("type_str").rlike(expression)).select("symbol_qn", "type_str").distinct()


def reference_counts(refs: DataFrame) -> DataFrame:
    """Uses of each symbol: references but definitions and imports."""
    return refs.where("ref_kind not in ('definition', 'import')").groupBy("symbol_qn").agg(F.count("*").alias("n_refs"))


def callees(call: DataFrame, caller: str) -> DataFrame:
    """callee_qn and line of a function's calls, each once."""
    return call.where(F.col("caller_qn") == caller).select("callee_qn", "line").distinct()


def recent(queries: DataFrame, limit: int = 50) -> DataFrame:
    """query and ts of the last time each query was asked, latest first; `limit` is the history's length."""
    return queries.groupBy("query").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "query").limit(limit)


def imported_only(matches: DataFrame, bound: DataFrame, imported: bool = True) -> DataFrame:
    """Matches (file_path, root) whose root name is, or is not, bound by an import (file_path, name) of the file."""
    names = bound.select("file_path", F.col("name").alias("root")).distinct()
    return matches.join(names, ["file_path", "root"], "left_semi" if imported else "left_anti")


def merged_config(configs: DataFrame) -> DataFrame:
    """role and pattern of several rule sets (position, role, pattern) in order, each once, where it came first."""
    return configs.groupBy("role", "pattern").agg(F.min("position").alias("position"))

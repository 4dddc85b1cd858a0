"""Symbol queries with filter families, mappings, and edit plans."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import names
from factweave.operators import ranges


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def query_symbols(
    symbols: DataFrame,
    kinds: list[str] = (),
    name: list[str] = (),
    decorators: list[str] = (),
    returns: list[str] = (),
    in_class: list[str] = (),
    depths: list[str] = (),
    params: list[str] = (),
    ignore_case: bool = False,
    smart_case: bool = False,
) -> DataFrame:
    """Symbols (search_symbol rows) that pass every given family of filters; inside a family any one is enough.

    kinds may end in *; depths are N or N+; patterns are globs or /expressions/.
    """
    like = lambda value, p: value.rlike(names.smart_case_regex(p)) if smart_case and re.fullmatch(r"\w+", p) else names.glob_match(value, p, ignore_case)
    if kinds:
        symbols = symbols.where(any_of([F.col("kind").startswith(k[:-1]) if k.endswith("*") else F.col("kind") == k for k in kinds]))
    if name:
        symbols = symbols.where(any_of([like(F.col("name"), p) for p in name]))
    if decorators:
        marks = F.filter(F.split(F.coalesce("decorators", F.lit("")), ","), lambda d: d != "")
        symbols = symbols.where(any_of([F.exists(marks, _liker(like, d.lstrip("@"))) for d in decorators]))
    if returns:
        symbols = symbols.where(any_of([like(F.coalesce("returns", F.lit("")), p) for p in returns]))
    if in_class:
        symbols = symbols.where(names.short_name(F.col("parent")).isin(list(in_class)) | F.col("parent").isin(list(in_class)))
    if depths:
        bad = [d for d in depths if not re.fullmatch(r"\d+\+?", d)]
        if bad:
            raise ValueError(f"not a depth: {bad[0]}")
        symbols = symbols.where(any_of([F.col("depth") >= int(d[:-1]) if d.endswith("+") else F.col("depth") == int(d) for d in depths]))
    if params:
        texts = parameters(F.col("signature"))
        bare = lambda x: F.regexp_extract(x, r"^\**([A-Za-z_]\w*)", 1)
        symbols = symbols.where(any_of([F.exists(texts, _param(like, bare, p)) for p in params]))
    return symbols


def _liker(like, pattern: str):
    return lambda x: like(x, pattern)


def _param(like, bare, pattern: str):
    return lambda x: like(x, pattern) | like(bare(x), pattern)


def parameters(signature: Column) -> Column:
    """Parameter texts of a signature, split at commas outside brackets."""
    inner = F.regexp_replace(signature, r"^\s*\(|\)\s*$", "")
    # Commas inside one level of brackets are hidden while splitting.
    hidden = F.regexp_replace(inner, r",(?=[^\[\](){}]*[\])}])", "\u0001")
    return F.transform(F.split(hidden, ","), lambda p: F.trim(F.regexp_replace(p, "\u0001", ",")))


def mappings_for(mappings: DataFrame, identifier: str, project: str | None = None, direction: str = "both") -> DataFrame:
    """Identifier mappings (source, target, source_project, target_project, ...) of an identifier."""
    source = (F.col("source") == identifier) & (F.lit(project is None) | (F.col("source_project") == (project or "")))
    target = (F.col("target") == identifier) & (F.lit(project is None) | (F.col("target_project") == (project or "")))
    return mappings.where({"source": source, "target": target, "both": source | target}[direction])


def search_mappings(mappings: DataFrame, text: str, relationship: str | None = None, limit: int = 50) -> DataFrame:
    hit = any_of([F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower())) for c in ("source", "target", "evidence")])
    if relationship is not None:
        hit = hit & (F.col("relationship") == relationship)
    return mappings.where(hit).orderBy("source", "target").limit(limit)


def rename_plan(symbol: DataFrame, reference: DataFrame, qualified: str, new_name: str) -> DataFrame:
    """Edits (file_path, line, col, length, replacement) that rename a symbol at its definition and references."""
    old = qualified.rpartition(".")[2]
    places = reference.where(F.col("symbol_qn") == qualified).select("file_path", "line", "col")
    own = symbol.where(F.col("qualified_name") == qualified).select("file_path", "line", F.lit(-1).cast("long").alias("col"))
    return places.union(own).distinct().select("file_path", "line", "col", F.lit(len(old)).alias("length"), F.lit(new_name).alias("replacement"))


def delete_plan(symbol: DataFrame, call: DataFrame, deleted: DataFrame, cascade: bool = True) -> DataFrame:
    """Line ranges of symbols to delete: those given (qn) and, with cascade, callees that only they call."""
    from factweave.operators.relational import cascade_dead

    gone = deleted.select("qn", F.lit("target").alias("reason"))
    if cascade:
        gone = gone.union(cascade_dead(call, deleted).select("qn", F.lit("cascade")))
    return symbol.join(gone, symbol.qualified_name == gone.qn).select("file_path", "line", "end_line", "qualified_name", "reason")


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """file_path and content after edits (file_path, start, stop, replacement; code points), null if two of a file overlap."""

    def apply(files: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for path, content in files[["file_path", "content"]].itertuples(index=False, name=None):
            out, at, ok = [], 0, True
            for a, b, text in sorted(edits[["start", "stop", "replacement"]].itertuples(index=False, name=None)):
                ok = ok and at <= a <= b <= len(content)
                out += [content[at:a], text]
                at = b
            rows.append((path, "".join([*out, content[at:]]) if ok else None))
        return pd.DataFrame(rows, columns=["file_path", "content"])

    return files.groupBy("file_path").cogroup(edits.groupBy("file_path")).applyInPandas(apply, "file_path string, content string")


def changed_symbols(symbol: DataFrame, intervals: DataFrame) -> DataFrame:
    """Symbols that own a changed line (file_path, start, stop half open): the deepest symbol that holds the line.

    The owner of a line is the last one to begin; ties go to the narrower.
    """
    lines = intervals.where("start < stop").select("file_path", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("changed")).distinct()
    held = ranges.holding(lines, symbol.select("file_path", "qualified_name", "line", "end_line"), ["file_path"], "changed", "line", "end_line").where("changed between line and end_line")
    owner = F.max_by("qualified_name", F.struct("line", -F.col("end_line"), "qualified_name"))
    return held.groupBy("file_path", "changed").agg(owner.alias("qualified_name")).select("qualified_name").distinct()


def without_literal_names(dead: DataFrame, literals: DataFrame) -> DataFrame:
    """Candidates (name) without those longer than three letters that stand as a word in any string literal (value)."""
    words = literals.select(F.explode(F.regexp_extract_all("value", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("name")).where("length(name) > 3").distinct()
    return dead.join(words, "name", "left_anti")


def search_symbols(symbols: DataFrame, query: str, limit: int = 50, kind: str | None = None, file_path: str | None = None) -> DataFrame:
    """qualified_name, name, score of the symbols found by any way (name equal, beginning, part or inside; qualified name; characters in order), each once; `limit` is the list's length."""
    from factweave.operators import relational

    rows = relational.matching(symbols, kind=kind, file_path=file_path)
    best = rows.groupBy("qualified_name", "name").agg(F.max(names.symbol_score(F.col("name"), F.col("qualified_name"), query)).alias("score"))
    return best.where("score > 0").orderBy(F.desc("score"), F.length("name"), "name", "qualified_name").limit(limit)


def dispatch(symbols: DataFrame, files: DataFrame, lines: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """kind and value of what a query finds, by its shape: lines of an expression, symbols of a selector, paths, or symbols by name."""
    from factweave.functions import selectors
    from factweave.operators import relational

    shape = selectors.shape(query)
    if shape == "expression":
        return lines.where(F.col("line_text").rlike(query.strip()[1:-1])).select(F.lit("line").alias("kind"), F.concat_ws(":", F.col("id").cast("string"), F.col("line").cast("string")).alias("value")).orderBy("value").limit(limit)
    if shape == "selector":
        s = selectors.selector(query if not query.startswith("::") else "**" + query)
        found = symbols.where(names.glob_match(F.col("name"), s.symbol_path[-1])) if s.symbol_path else symbols
        if s.file_path not in (None, "**"):
            found = found.where(F.col("file_path").rlike(names.path_glob_regex(s.file_path)))
        return found.select(F.lit("symbol").alias("kind"), F.col("qualified_name").alias("value")).orderBy("value").limit(limit)
    if shape == "path":
        top = relational.top(files.select("file_path").distinct(), names.file_score(F.col("file_path"), query), ["file_path"], limit)
        return top.select(F.lit("file").alias("kind"), F.col("file_path").alias("value"))
    return search_symbols(symbols, query, limit).select(F.lit("symbol").alias("kind"), F.col("qualified_name").alias("value"))


def literal_references(reference: DataFrame, literals: list[str], limit: int | None = None) -> DataFrame:
    """References whose symbol holds any of the texts, by file and line; `limit` is the list's length."""
    out = reference.where(any_of([F.contains(F.col("symbol_qn"), F.lit(x)) for x in literals])).orderBy("file_path", "line", "col", "symbol_qn", "ref_kind")
    return out if limit is None else out.limit(limit)


def with_environment(project: DataFrame, environment: DataFrame, asked: DataFrame) -> DataFrame:
    """name, qualified_name, origin of each asked name: the project's symbols, and the environment's for names that the project lacks."""
    own = asked.join(project.select("name", "qualified_name"), "name").withColumn("origin", F.lit("project"))
    rest = asked.join(project.select("name").distinct(), "name", "left_anti")
    return own.unionByName(rest.join(environment.select("name", "qualified_name"), "name").withColumn("origin", F.lit("environment")))

"""Embedded languages in texts: region detection, symbols, text search and line rewriting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import names

SQL = r"(?is)^\s*(?:select\b.+\bfrom\b|insert\s+into\b|update\b.+\bset\b|delete\s+from\b|create\s+table\b|with\b.+\bselect\b)"
JINJA = r"\{\{.*?\}\}|\{%.*?%\}"
GRAPHQL = r"(?s)^\s*(?:query|mutation|subscription|fragment|type|input|enum|interface)\b.*\{"


def region_kind(literal: Column) -> Column:
    """sql, jinja or graphql of a string literal, or null."""
    return F.when(literal.rlike(SQL), "sql").when(literal.rlike(JINJA), "jinja").when(literal.rlike(GRAPHQL), "graphql")


def sql_tables(text: Column) -> Column:
    """Lower-case distinct tables after from, join, into, update and table."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update|table)\s+([A-Za-z_][\w.]*)"), F.lit(1)), F.lower)))


def jinja_names(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{\s*([A-Za-z_]\w*)"), F.lit(1))))


def graphql_types(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:type|input|enum|interface)\s+([A-Za-z_]\w*)"), F.lit(1))))


def pattern_regex(pattern: str) -> str:
    """Java expression of a text pattern: $X an identifier, $...X anything, the same name the same text, spaces any run."""
    out, seen = "", set()
    for part in re.split(r"(\$(?:\.\.\.)?[A-Za-z_]\w*|\s+)", pattern):
        if part.isspace():
            out += r"\s+"
        elif part.startswith("$"):
            name = re.sub(r"\W|_", "", part)
            if part == "$_":
                out += r"\w+"
            elif name in seen:
                out += rf"\k<{name}>"
            else:
                seen.add(name)
                out += rf"(?<{name}>.*?)" if part.startswith("$...") else rf"(?<{name}>\w+)"
        else:
            out += re.escape(part)
    return out


def grep(lines: DataFrame, expression: str) -> DataFrame:
    """Lines (id, line, line_text) that hold a match."""
    return lines.where(F.col("line_text").rlike(expression))


def orm_links(tables: DataFrame, classes: DataFrame) -> DataFrame:
    """table, class and confidence: exact table name of a class 0.95, else singular Pascal name 0.8.

    classes: class, table_name (null if not declared).
    """
    pascal = names.pascal(names.singular(F.col("table")))
    exact = classes.where("table_name is not null").select(F.col("table_name").alias("table"), F.col("class").alias("exact"))
    named = classes.select(F.col("class").alias("pascal"), F.col("class").alias("by_name"))
    out = tables.withColumn("pascal", pascal).join(exact, "table", "left").join(named, "pascal", "left").where("exact is not null or by_name is not null")
    return out.select("table", F.coalesce("exact", "by_name").alias("class"), F.when(F.col("exact").isNotNull(), 0.95).otherwise(0.8).alias("confidence"))


def rewritten(lines: DataFrame, rules: list[tuple[str, str]], most: int = 30) -> DataFrame:
    """Lines after the rules (expression, replacement) were applied again and again until nothing changes."""

    def apply(parts):
        compiled = [(re.compile(a), b) for a, b in rules]
        for part in parts:
            part = part.copy()
            texts = []
            for text in part["line_text"]:
                for _ in range(most):
                    new = text
                    for rx, to in compiled:
                        new = rx.sub(to, new)
                    if new == text:
                        break
                    text = new
                texts.append(text)
            part["line_text"] = texts
            yield part

    return lines.mapInPandas(apply, lines.schema)


def find_in(regions: DataFrame, pattern: str, kind: str = "sql") -> DataFrame:
    """Each match of a text pattern in the string literals (id, value) that are a region of the kind: id and match."""
    hits = F.regexp_extract_all("value", F.lit(pattern_regex(pattern)), F.lit(0))
    return regions.where(region_kind(F.col("value")) == kind).select("id", F.explode(hits).alias("match"))


def sql_columns(text: Column) -> Column:
    """Distinct bare columns of the first select list."""
    listed = F.regexp_extract(text, r"(?is)\bselect\s+(?:distinct\s+)?(.*?)\s+from\b", 1)
    parts = F.transform(F.split(listed, ","), lambda x: F.regexp_extract(F.trim(x), r"^(?:\w+\.)?([A-Za-z_]\w*)$", 1))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def jinja_blocks(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{%-?\s*(?:block|macro)\s+([A-Za-z_]\w*)"), F.lit(1))))


def template_links(variables: DataFrame, renders: DataFrame) -> DataFrame:
    """template, name, file_path, line of template variables (template, name) and the calls (template, keyword, file_path, line) that pass them."""
    return variables.distinct().join(renders.withColumnRenamed("keyword", "name"), ["template", "name"]).select("template", "name", "file_path", "line").distinct()


def graphql_links(types: DataFrame, classes: DataFrame, resolvers: DataFrame) -> DataFrame:
    """type, field, target: fields (type, field) with the resolver function resolve_<field>, else with the class of the type's name."""
    by_name = resolvers.select(F.regexp_replace("name", "^resolve_", "").alias("field"), F.col("name").alias("resolver")).where("resolver like 'resolve\\\\_%'")
    out = types.join(by_name, "field", "left").join(classes.select(F.col("class").alias("type"), F.col("class").alias("owner")).distinct(), "type", "left")
    return out.where("resolver is not null or owner is not null").select("type", "field", F.coalesce("resolver", "owner").alias("target")).distinct()


def impact(changed: DataFrame, links: DataFrame, regions: DataFrame) -> DataFrame:
    """class, table and id of text regions (id, tables) that name a table linked (table, class) to a changed class (class)."""
    tables = links.join(changed.select("class").distinct(), "class", "left_semi").select("class", "table").distinct()
    return regions.select("id", F.explode("tables").alias("table")).distinct().join(tables, "table").select("class", "table", "id")

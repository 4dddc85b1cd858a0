"""Selectors, query shapes and where clauses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed words of the selector language.
COMPONENTS = ("params", "returns", "decorators", "bases", "body", "imports")
PSEUDO = ("KEYWORD_ONLY", "POSITIONAL_ONLY", "POSITIONAL_OR_KEYWORD")
STRUCTURAL = ("def", "async def", "class", "for", "while", "try", "with", "if", "except")
_LINES = re.compile(r"(?P<file>.+):(?P<first>\d+)(?:-(?P<last>\d+))?")
_NAME = re.compile(r"[A-Za-z_*][\w*]*")
_FILTER = re.compile(r":(returns|type)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]")
_PART = re.compile(rf"\[({'|'.join(COMPONENTS)})\](?:\[(-?\d+|[A-Za-z_]\w*)\])?(?::({'|'.join(PSEUDO)}))?")


@dataclass(frozen=True)
class Selector:
    file_path: str | None = None
    symbol_path: tuple[str, ...] = ()
    type_filter: tuple[str, str] | None = None
    #: (component, accessor or None, pseudo class or None)
    components: tuple[tuple[str, str | None, str | None], ...] = ()
    lines: tuple[int, int] | None = None


def selector(text: str) -> Selector:
    """file::Symbol.path:returns[T][component][accessor]:PSEUDO, Symbol.path..., file:4 or file:4-10; ValueError for anything else."""
    text = text.strip()
    if "::" not in text and (m := _LINES.fullmatch(text)):
        return Selector(m["file"], lines=(int(m["first"]), int(m["last"] or m["first"])))
    file_path, mark, rest = text.partition("::")
    if not mark:
        file_path, rest = None, text
    elif not file_path or re.search(r"[:\[\s]", file_path):
        raise ValueError(f"not a file: {file_path!r}")
    path, at = [], 0
    while m := _NAME.match(rest, at):
        path.append(m[0])
        at = m.end()
        if rest[at : at + 1] != ".":
            break
        at += 1
    kind = None
    if m := _FILTER.match(rest, at):
        kind, at = (m[1], m[2]), m.end()
    parts = []
    while m := _PART.match(rest, at):
        parts.append((m[1], m[2], m[3]))
        at = m.end()
    if at < len(rest) or rest[at - 1 : at] == "." or not mark and not path:
        raise ValueError(f"not a selector: {text!r}")
    return Selector(file_path, tuple(path), kind, tuple(parts))


def shape(query: str) -> str:
    """lines, pattern, selector, expression, path or symbol: how a search query is to be read."""
    query = query.strip()
    if len(query) > 1 and query[0] == query[-1] == "/":
        return "expression"
    if re.search(r":\d+(-\d+)?$", query):
        return "lines"
    if "::" in query:
        if "$" in query.partition("::")[2]:
            return "pattern"
        try:
            selector(query if not query.startswith("::") else "**" + query)
            return "selector"
        except ValueError:
            return "pattern"
    if "$" in query or re.match(r"(?:async\s+)?(?:def|class)\s+\w*[*?]", query):
        return "pattern"
    return "path" if "/" in query or re.fullmatch(r"[\w.-]+\.(?:pyi?|tsx?|jsx?|rs)", query) else "symbol"


@dataclass(frozen=True)
class Where:
    inside: str | None = None
    not_inside: str | None = None
    matching: str | None = None
    scope: tuple[str, ...] = field(default=())


def where(values: list[str]) -> Where:
    """not X: outside of X; @name or a pattern with $: to match; a kind of statement: inside of it; else a dotted scope.  Later values win."""
    found: dict[str, object] = {}
    for value in map(str.strip, values):
        if not value:
            raise ValueError("an empty where clause")
        if value.startswith("not "):
            found["not_inside"] = value[4:].strip()
        elif value.startswith("@") or "$" in value:
            found["matching"] = value
        elif any(re.match(rf"{word}(?:$|[ :])", value) for word in STRUCTURAL):
            found["inside"] = value
        else:
            found["scope"] = tuple(value.split("."))
    return Where(**found)


def repaired(pattern: str) -> str:
    """A pattern that is still being typed: open brackets and quotes are closed, a bare $ stands for anything."""
    out, stack, quote = "", [], ""
    for c in pattern:
        out += c
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            stack.append(")]}"["([{".index(c)])
        elif stack and c == stack[-1]:
            stack.pop()
    return re.sub(r"\$(?![\w.])", "$_", out + quote + "".join(reversed(stack)))


def parsed_selectors(queries: DataFrame) -> DataFrame:
    """query, shape, and the parts of a selector or line range: file_path, symbol_path, component, accessor, first and last line."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for query in part["query"]:
                kind = shape(query)
                s = selector(query) if kind in ("selector", "lines") else Selector()
                component = s.components[0] if s.components else (None, None, None)
                rows.append((query, kind, s.file_path, ".".join(s.symbol_path) or None, component[0], component[1], *(s.lines or (None, None))))
            yield pd.DataFrame(rows, columns=["query", "shape", "file_path", "symbol_path", "component", "accessor", "first_line", "last_line"])

    return queries.select("query").mapInPandas(run, "query string, shape string, file_path string, symbol_path string, component string, accessor string, first_line long, last_line long")

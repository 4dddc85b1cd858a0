"""Tree patterns over Python sources.

A pattern is Python text with metavariables: $X one expression or name, $...X any number of arguments, elements or
statements, $_ anything unnamed; $X:int, $X:str, $X:call, $X:attr, $X:identifier or $X:any bound the kind.  The same name
must match the same text.  Matching is a map over files; files that lack a word of the pattern are left out before any
is parsed.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import names

META = re.compile(r"\$(\.\.\.)?(\w+|_)(?::(int|str|float|call|attr|identifier|stmt|any|expr))?")
MATCHES = "file_path string, line long, col long, end_line long, end_col long, text string, captures map<string,string>"
KINDS = {"call": ast.Call, "attr": ast.Attribute, "identifier": ast.Name, "expr": ast.expr, "any": ast.AST, "stmt": ast.stmt}


class Pattern:
    def __init__(self, text: str):
        self.text = text
        self.holes: dict[str, tuple[str, bool, str]] = {}

        def hole(m: re.Match) -> str:
            name = f"_hole{len(self.holes)}_"
            self.holes[name] = (m[2], bool(m[1]), m[3] or "any")
            return name

        source = META.sub(hole, text)
        tree = ast.parse(source)
        body = tree.body
        self.node: ast.AST = body[0].value if len(body) == 1 and isinstance(body[0], ast.Expr) else body[0] if body else ast.Pass()

    def hole(self, node: ast.AST | str) -> tuple[str, bool, str] | None:
        if isinstance(node, ast.Expr):
            node = node.value
        if isinstance(node, ast.Name):
            node = node.id
        if isinstance(node, ast.arg):
            node = node.arg
        return self.holes.get(node) if isinstance(node, str) else None

    def match(self, want, have, got: dict[str, str]) -> dict[str, str] | None:
        """Captures that make `want` equal `have`, or None."""
        hole = self.hole(want) if isinstance(want, (ast.AST, str)) else None
        if hole and not hole[1]:
            return bind(hole, have, got)
        if isinstance(want, ast.AST):
            if type(want) is not type(have):
                return None
            for field in want._fields:
                if field in ("ctx", "type_comment", "kind", "type_ignores"):
                    continue
                a, b = getattr(want, field, None), getattr(have, field, None)
                got = self.sequence(a, b, got) if isinstance(a, list) else self.match(a, b, got)
                if got is None:
                    return None
            return got
        return got if want == have else None

    def sequence(self, want: list, have, got: dict[str, str]) -> dict[str, str] | None:
        """Elements in order; an ellipsis hole takes as few as it can."""
        if not isinstance(have, list):
            return None
        if not want:
            return got if not have else None
        hole = self.hole(want[0]) if isinstance(want[0], (ast.AST, str)) else None
        if hole and hole[1]:
            for n in range(len(have) + 1):
                bound = bind(hole, have[:n], got)
                if bound is not None and (rest := self.sequence(want[1:], have[n:], bound)) is not None:
                    return rest
            return None
        if not have:
            return None
        first = self.match(want[0], have[0], got)
        return None if first is None else self.sequence(want[1:], have[1:], first)

    def find(self, tree: ast.AST) -> Iterator[tuple[ast.AST, dict[str, str], list[ast.AST]]]:
        """Matches in pre-order with their captures and ancestors."""
        todo: list[tuple[ast.AST, list[ast.AST]]] = [(tree, [])]
        while todo:
            node, above = todo.pop()
            if hasattr(node, "lineno") and (got := self.match(self.node, node, {})) is not None:
                yield node, got, above
            todo.extend((c, [*above, node]) for c in reversed(list(ast.iter_child_nodes(node))))


def bind(hole: tuple[str, bool, str], have, got: dict[str, str]) -> dict[str, str] | None:
    name, many, kind = hole
    if not many:
        if have is None or isinstance(have, list):
            return None
        if isinstance(have, ast.AST):
            if kind in ("int", "str", "float"):
                if not (isinstance(have, ast.Constant) and type(have.value).__name__ == kind):
                    return None
            elif not isinstance(have, KINDS[kind]):
                return None
    text = ", ".join(map(as_text, have)) if many else as_text(have)
    if name == "_":
        return got
    return got | {name: text} if got.get(name, text) == text else None


def as_text(node) -> str:
    return ast.unparse(node) if isinstance(node, ast.AST) else str(node)


def scope_names(above: list[ast.AST]) -> list[str]:
    return [a.name for a in above if isinstance(a, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]


def holds_words(content: Column, pattern: str) -> Column:
    return names.holds_words(content, META.sub(" ", pattern))


def find(files: DataFrame, pattern: str, inside: str | None = None, not_inside: str | None = None) -> DataFrame:
    """Matches of a pattern in files (file_path, content).

    inside and not_inside name kinds of statements around a match (for, while, if, try, with, def, class) or a function or
    class by @name.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = Pattern(pattern)
        for part in parts:
            rows = []
            for path, content in part[["file_path", "content"]].itertuples(index=False, name=None):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                seen = set()
                for node, got, above in compiled.find(tree):
                    span = (node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)
                    if span in seen or inside and not around(above, inside) or not_inside and around(above, not_inside):
                        continue
                    seen.add(span)
                    rows.append((path, *span, ast.unparse(node), got))
            yield pd.DataFrame(rows, columns=["file_path", "line", "col", "end_line", "end_col", "text", "captures"])

    return files.where(holds_words(F.col("content"), pattern)).select("file_path", "content").mapInPandas(run, MATCHES)


AROUND = {
    "for": (ast.For, ast.AsyncFor), "while": (ast.While,), "if": (ast.If,), "try": (ast.Try,), "with": (ast.With, ast.AsyncWith),
    "def": (ast.FunctionDef, ast.AsyncFunctionDef), "async def": (ast.AsyncFunctionDef,), "class": (ast.ClassDef,),
}


def around(above: list[ast.AST], what: str) -> bool:
    if what.startswith("@"):
        return what[1:] in scope_names(above)
    return any(isinstance(a, AROUND[what]) for a in above)


def find_many(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Matches of several patterns with the name of their rule; each file is parsed once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {name: Pattern(text) for name, text in rules.items()}
        for part in parts:
            rows = []
            for path, content in part[["file_path", "content"]].itertuples(index=False, name=None):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for name, p in compiled.items():
                    rows += [(name, path, n.lineno, n.col_offset, json.dumps(got, sort_keys=True)) for n, got, _ in p.find(tree)]
            yield pd.DataFrame(rows, columns=["rule", "file_path", "line", "col", "captures"])

    return files.select("file_path", "content").mapInPandas(run, "rule string, file_path string, line long, col long, captures string")


def replacement_plan(matches: DataFrame, template: str) -> DataFrame:
    """Edits of matches: file, span and the template with $X filled in."""
    out = F.lit(template)
    for name in sorted(set(re.findall(r"\$(\w+)", template)), key=len, reverse=True):
        out = F.replace(out, F.lit(f"${name}"), F.coalesce(F.element_at("captures", F.lit(name)), F.lit(f"${name}")))
    return matches.select("file_path", "line", "col", "end_line", "end_col", out.alias("replacement"))

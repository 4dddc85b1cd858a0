"""Subtrees of Python sources in a form that doesn't depend on the names of what they bind, for finding clones."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from factweave.extract.python import FUNCTIONS

SUBTREES = "file_path string, symbol string, line long, end_line long, kinds array<string>, tokens array<string>, depth int"
#: Subtrees that are compared: functions, classes and compound statements.
ROOTS = (*FUNCTIONS, ast.ClassDef, ast.For, ast.AsyncFor, ast.While, ast.If, ast.With, ast.AsyncWith, ast.Try, ast.Match)


def bound_names(root: ast.AST) -> set[str]:
    """Names that a subtree itself defines: parameters, targets, handlers, imports, inner functions, and its own name."""
    out: set[str] = set()
    for n in ast.walk(root):
        if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
            out.add(n.id)
        elif isinstance(n, ast.arg):
            out.add(n.arg)
        elif isinstance(n, (*FUNCTIONS, ast.ClassDef)) or isinstance(n, ast.ExceptHandler) and n.name:
            out.add(n.name)
        elif isinstance(n, ast.alias):
            out.add((n.asname or n.name).split(".")[0])
    return out


def canonical(root: ast.AST) -> tuple[list[str], list[str], int]:
    """Kinds and tokens of a subtree in source order, and its depth; bound names are numbered in the order of their first use."""
    own, number = bound_names(root), {}
    kinds: list[str] = []
    tokens: list[str] = []
    deepest = 0

    def name(text: str) -> str:
        return f"bound_{number.setdefault(text, len(number))}" if text in own else text

    todo: list[tuple[ast.AST, int]] = [(root, 1)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, (ast.Load, ast.Store, ast.Del)):
            continue
        deepest = max(deepest, depth)
        kinds.append(type(node).__name__.lower())
        if isinstance(node, ast.Name):
            tokens.append(name(node.id))
        elif isinstance(node, ast.arg):
            tokens.append(name(node.arg))
        elif isinstance(node, ast.Constant):
            tokens.append(repr(node.value))
        elif isinstance(node, ast.Attribute):
            tokens.append(node.attr)
        elif isinstance(node, (*FUNCTIONS, ast.ClassDef)) or isinstance(node, ast.ExceptHandler) and node.name:
            tokens.append(name(node.name))
        elif isinstance(node, ast.keyword) and node.arg:
            tokens.append(node.arg)
        todo.extend((c, depth + 1) for c in reversed(list(ast.iter_child_nodes(node))))
    return kinds, tokens, deepest


def subtrees_of(file_path: str, module: str, source: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    todo: list[tuple[ast.AST, str]] = [(tree, module)]
    while todo:
        node, inside = todo.pop()
        here = f"{inside}.{node.name}" if isinstance(node, (*FUNCTIONS, ast.ClassDef)) else inside
        if isinstance(node, ROOTS):
            yield (file_path, here, node.lineno, node.end_lineno, *canonical(node))
        todo.extend((c, here) for c in reversed(list(ast.iter_child_nodes(node))))


def subtrees(files: DataFrame) -> DataFrame:
    """Every subtree of the files (file_path, module_name, content) that is compared; files that don't parse have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for row in part.itertuples(index=False) for r in subtrees_of(row.file_path, row.module_name, row.content or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUBTREES.split(", ")])

    return files.select("file_path", "module_name", "content").mapInPandas(run, SUBTREES)

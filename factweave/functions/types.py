"""Types as trees, read from the spellings of several languages, and whether one satisfies another.

A tree is (kind, name, parts): kind any (unknown, a wildcard in a constraint), name, of (name with parameters), either (parts are the members)
or call (parts are the parameters, then the result or None).
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple[str, str, tuple]
ANY: Tree = ("any", "", ())
_TOKEN = re.compile(r"\s*(->|=>|\[\]|'[a-z]\w*(?=\s)|[\[\]<>(),|&?:]|(?:\.\.\.)|[^\s\[\]<>(),|&?:'=-]+|.)")


class _Reader:
    """Recursive descent over the tokens of one type."""

    def __init__(self, text: str):
        self.tokens = [t for t in _TOKEN.findall(text) if t.strip()]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.peek():
            self.at += 1
            return True
        return False

    def either(self) -> Tree:
        members = [self.postfix()]
        while self.take("|"):
            members.append(self.postfix())
        return members[0] if len(members) == 1 else ("either", "", tuple(members))

    def postfix(self) -> Tree:
        out = self.single()
        while self.take("[]"):
            out = ("of", "Array", (out,))
        return out

    def single(self) -> Tree:
        if self.take("&"):
            while self.peek().startswith("'") or self.peek() == "mut":
                self.at += 1
            return ("of", "&", (self.postfix(),))
        if self.take("("):
            given = self.listed(")")
            if self.take("->", "=>"):
                return ("call", "", (*given, self.either()))
            return given[0] if len(given) == 1 else ("of", "tuple", tuple(given))
        if not self.peek() or self.peek() in "])>,|":
            return ANY
        name = self.peek().removeprefix("Self@")
        self.at += 1
        if self.take("["):
            return ("of", name, tuple(self.listed("]")))
        if self.take("<"):
            return ("of", name, tuple(self.listed(">")))
        return ANY if name in ("Unknown", "?") else ("name", name, ())

    def listed(self, end: str) -> list[Tree]:
        out: list[Tree] = []
        while self.peek() and not self.take(end):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ":":  # a parameter's name
                self.at += 2
            out.append(self.either())
            if not self.take(",") and self.peek() != end:
                self.at += 1
        return out


@functools.lru_cache(10_000)
def parsed(text: str) -> Tree:
    """Tree of a type; what can't be read is a plain name."""
    reader = _Reader(text.strip())
    tree = reader.either()
    return tree if reader.at >= len(reader.tokens) else ("name", text.strip(), ())


def same_name(wanted: str, have: str) -> bool:
    """Equal, or one is the last part of the other."""
    return wanted == have or have.rpartition(".")[2] == wanted or wanted.rpartition(".")[2] == have


def satisfies(have: Tree, wanted: Tree) -> bool:
    if wanted[0] == "any":
        return True
    if have[0] == "any":
        return False
    if wanted[0] == "either":
        mine = have[2] if have[0] == "either" else (have,)
        return any(satisfies(m, w) for m in mine for w in wanted[2])
    if have[0] == "either":
        return any(satisfies(m, wanted) for m in have[2])
    if wanted[0] == "name":
        return have[0] in ("name", "of") and same_name(wanted[1], have[1])
    same = have[0] == wanted[0] and len(have[2]) == len(wanted[2])
    return same and (wanted[0] == "call" or same_name(wanted[1], have[1])) and all(map(satisfies, have[2], wanted[2]))


def type_satisfies(type_str: Column, constraint: str) -> Column:
    """Whether a type satisfies a constraint by structure; null types satisfy only a wildcard."""
    wanted = parsed(constraint)

    @F.pandas_udf("boolean")
    def check(types: pd.Series) -> pd.Series:
        known = {t: satisfies(parsed(t or ""), wanted) for t in types.unique()}
        return types.map(known).astype(bool)

    return check(F.coalesce(type_str, F.lit("")))

"""Types, selectors, where clauses, rule documents and rewriting, by example."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from factweave.extract import subtrees
from factweave.functions import selectors, types
from factweave.operators import ranges, rewriting, rules


def test_types_are_read_alike_from_several_languages():
    parsed = types.parsed
    assert parsed("str | None") == ("either", "", (("name", "str", ()), ("name", "None", ())))
    assert parsed("A | B[]") == ("either", "", (("name", "A", ()), ("of", "Array", (("name", "B", ()),))))
    assert parsed("dict[str, list[int]]") == ("of", "dict", (("name", "str", ()), ("of", "list", (("name", "int", ()),))))
    assert parsed("Vec<&'a mut T>") == ("of", "Vec", (("of", "&", (("name", "T", ()),)),))
    assert parsed("(x: int, y: str) -> bool") == parsed("(int, str) => bool") == ("call", "", (("name", "int", ()), ("name", "str", ()), ("name", "bool", ())))
    assert parsed("Self@Box") == ("name", "Box", ()) and parsed("") == parsed("Unknown") == types.ANY
    assert parsed("a b ]")[0] == "name"


@pytest.mark.parametrize(
    ("have", "wanted", "fits"),
    [
        ("int", "Unknown", True), ("Unknown", "int", False), ("lib.Conn", "Conn", True), ("list[int]", "list", True), ("list[int]", "list[?]", True),
        ("list[int]", "list[str]", False), ("list[int]", "dict[int]", False), ("int | None", "None", True), ("int | str", "str | bytes", True), ("int", "str | bytes", False),
        ("(int) -> str", "(int) -> ?", True), ("(int) -> str", "(int, int) -> str", False), ("int", "(int) -> int", False),
    ],
)
def test_types_satisfy_constraints(have, wanted, fits):
    assert types.satisfies(types.parsed(have), types.parsed(wanted)) is fits


def test_selectors():
    s = selectors.selector("a/b.py::C.m:returns[list[int]][params][x]:KEYWORD_ONLY")
    assert (s.file_path, s.symbol_path, s.type_filter, s.components) == ("a/b.py", ("C", "m"), ("returns", "list[int]"), (("params", "x", "KEYWORD_ONLY"),))
    assert selectors.selector("a.py:4-10").lines == (4, 10) and selectors.selector("a.py:4").lines == (4, 4)
    assert selectors.selector("pkg.mod.f*[body]").symbol_path == ("pkg", "mod", "f*")
    assert selectors.selector("a.py::[imports][-1]").components == (("imports", "-1", None),)
    for bad in ("", "::f", "a.py::f[nothing]", "a.py::f.", "a b::f"):
        with pytest.raises(ValueError, match="not a"):
            selectors.selector(bad)


def test_query_shapes_and_where_clauses():
    shapes = {q: selectors.shape(q) for q in ("f($X)", "def get_*", "a.py:3-9", "a.py::f", "::f", "a.py::f($X)", "/x+/", "src/a.py", "a.rs", "Name")}
    assert list(shapes.values()) == ["pattern", "pattern", "lines", "selector", "selector", "pattern", "expression", "path", "path", "symbol"]
    w = selectors.where(["not for", "@route", "async def f", "A.b"])
    assert (w.not_inside, w.matching, w.inside, w.scope) == ("for", "@route", "async def f", ("A", "b"))
    assert selectors.where(["format.x"]).scope == ("format", "x")
    with pytest.raises(ValueError, match="empty"):
        selectors.where([" "])
    assert selectors.repaired("f($, [x, 'a") == "f($_, [x, 'a'])"


def test_rule_documents():
    found = rules.compiled({"macros": {"a": "f({b})", "b": "$X"}, "presets": "unsafe-python", "rules": [{"id": "r", "pattern": "{a}"}, {"id": "eval", "pattern": "eval()", "severity": "info"}]})
    assert [r.id for r in found] == ["r", "eval", "exec"]
    assert found[0].body["pattern"] == "f($X)" and found[1].severity == "info"
    for bad, why in (({"id": "x"}, "no kind"), ({"id": "x", "pattern": "y", "severity": "z"}, "severity"), ({"id": "x", "kind": "flow", "from": "a"}, "from and to")):
        with pytest.raises(ValueError, match=why):
            rules.compiled({"rules": [bad]})
    with pytest.raises(ValueError, match="themselves"):
        rules.expanded("{a}", {"a": "{b}", "b": "{a} "})
    assert rules.document('{"rules": []}') == {"rules": []}


def test_rewriting_finds_the_cheapest_equal_term():
    graph = rewriting.Equalities()
    c = graph.add(rewriting.read("(a * 2) / 2"))
    rules_ = [(rewriting._holes(x), rewriting._holes(y)) for x, y in (("div(mult(A, B), C)", "mult(A, div(B, C))"), ("div(2, 2)", "1"), ("mult(A, 1)", "A"))]
    assert graph.saturate(rules_) < rewriting.ROUNDS
    assert graph.cheapest(c) == "a"
    assert graph.cheapest(c, lambda op, parts: (100 if op == "a" and not parts else 1) + sum(parts)) is not None
    endless = rewriting.Equalities()
    k = endless.add(rewriting.read("g(x)"))
    assert endless.saturate([(rewriting._holes("g(A)"), rewriting._holes("g(g(A))"))], 5) <= 5 and rewriting.shown(endless.cheapest(k)) == "g(x)"


def test_ranges_of_any_length_equal_brute_force(spark):
    rng = random.Random(7)
    spans = [(rng.choice("ab"), s, s + rng.choice([1, 2, 3, 64, 65, 1000, 10**9])) for s in (rng.randrange(-50, 3000) for _ in range(60))]
    points = [(k, p) for k in "ab" for p in [-51, -1, 0, *range(0, 3000, 97), 10**9]]
    left = spark.createDataFrame(spans, "k string, start long, stop long")
    right = spark.createDataFrame([(k, a + 5, a + 5 + n) for (k, a, _), n in zip(spans, [1, 7, 5000] * 20, strict=True)], "k string, r_start long, r_stop long")
    got = sorted(tuple(r) for r in ranges.overlapping(left, right, "k").collect())
    assert got == sorted((k, a, b, c, d) for k, a, b in spans for j, c, d in map(tuple, right.collect()) if j == k and a < d and c < b)
    dots = spark.createDataFrame(points, "k string, at long")
    held = ranges.holding(dots, left.withColumn("last", F.col("stop") - 1), ["k"], "at", "start", "last").where("at between start and last")
    assert sorted((r.k, r["at"], r.start, r.stop) for r in held.collect()) == sorted((k, p, a, b) for k, p in points for j, a, b in spans if j == k and a <= p < b)


def test_subtrees_forget_bound_names():
    of = lambda text: subtrees.canonical(ast.parse(text).body[0])
    assert of("def f(a, b):\n    c = a + g(b)\n    return c") == of("def h(x, y):\n    z = x + g(y)\n    return z")
    assert of("def f(a):\n    return g(a)") != of("def f(a):\n    return h(a)") and of("def f(a):\n    return 1") != of("def f(a):\n    return 2")
    assert of("for i in r:\n    p(i, i)") != of("for i in r:\n    p(i, j)")
    kinds, tokens, depth = of("def f(a):\n    return a")
    assert (kinds, tokens, depth) == (["functiondef", "arguments", "arg", "return", "name"], ["bound_0", "bound_1", "bound_1"], 3)
    assert [r[1:4] for r in subtrees.subtrees_of("a.py", "a", "class C:\n    def m(self):\n        if x:\n            y()\n")] == [("a.C", 1, 4), ("a.C.m", 2, 4), ("a.C.m", 3, 4)]
    assert not list(subtrees.subtrees_of("a.py", "a", "def ("))

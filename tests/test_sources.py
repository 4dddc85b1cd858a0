"""Extraction, patterns, flow graphs and edit plans on small Python sources."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factweave.extract import python
from factweave.functions import names
from factweave.operators import flow, patterns, search
from factweave.schema import RELATIONS
from factweave.sources import scan
from factweave.sources.store import FactStore

APP = '''"""Doc."""
import os
from lib.core import compute as c, helper

__all__ = ["main"]


@app.route("/x")
def main(a: int, b=2) -> str:  # entry
    total = a
    for k in range(b):
        if k > 3:
            break
        total += c(k)
    while True:
        helper(total)
        return os.path.join("x", str(total))


class Box(Base):
    async def open(self):
        try:
            self.lid.lift()
        except OSError:
            raise
        finally:
            main(1)
'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [("app.py", "app", APP), ("bad.py", "bad", "def ("), ("none.py", "none", None)]
    return spark.createDataFrame(rows, "file_path string, module_name string, content string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_extracted_facts(files):
    facts = python.extracted(files)
    of = lambda name: python.relation(facts, name)
    assert rows(of("symbol"), "qualified_name", "kind") == [("app.Box", "class"), ("app.Box.open", "async_method"), ("app.main", "function")]
    assert ("app.main", "lib.core.compute") in rows(of("call"), "caller_qn", "callee_qn")
    assert ("app.Box.open", "app.main") in rows(of("call"), "caller_qn", "callee_qn")
    assert ("app.main", "os.path.join") in rows(of("call"), "caller_qn", "callee_qn")
    assert rows(of("import"), "imported_module", "imported_name") == [("lib.core", "compute"), ("lib.core", "helper"), ("os", "")]
    assert rows(of("decorator_on"), "symbol_qn", "decorator") == [("app.main", "app.route")]
    assert rows(of("exported_symbol"), "qualified_name") == [("app.main",)]
    assert ("app.Box.open", "self.lid", "lift") in rows(of("method_call"), "func_qn", "receiver", "method")
    assert ("total", "aug_write") in rows(of("def_use"), "var_name", "kind")
    assert {k for (k,) in rows(of("cfg_edge"), "edge_kind")} >= {"true_branch", "false_branch", "back_edge", "jump", "exception", "finally"}
    assert rows(facts.where("relation = 'error'"), "relation") == [("error",)]


def test_literals_and_comments(files):
    assert [r.value for r in python.comments(files).collect()] == ["# entry"]
    assert {"Doc.", "main", "/x", "x"} <= {r.value for r in python.string_literals(files).collect()}


@pytest.mark.parametrize(
    ("pattern", "lines"),
    [("range($X)", [11]), ("$F($...A)", [8, 11, 14, 16, 17, 17, 23, 27]), ("$X.join($...A)", [17]), ("c($X:int)", []), ("main($X:int)", [27]), ("$A > 3", [12])],
)
def test_patterns(files, pattern, lines):
    assert sorted(r.line for r in patterns.find(files, pattern).collect()) == lines


def test_pattern_scopes_and_captures(files):
    assert [r.line for r in patterns.find(files, "c($X)", inside="for").collect()] == [14]
    assert patterns.find(files, "c($X)", not_inside="@main").count() == 0
    match = patterns.find(files, "os.path.join($A, $B)")
    assert match.first().captures == {"A": "'x'", "B": "str(total)"}
    assert patterns.replacement_plan(match, "joined($B, $A)").first().replacement == "joined(str(total), 'x')"
    assert rows(patterns.find_many(files, {"r": "range($X)", "h": "helper($X)"}), "rule", "line") == [("h", 16), ("r", 11)]


def test_same_name_means_same_text(spark):
    files = spark.createDataFrame([("a.py", "f(x, x)\nf(x, y)\n")], "file_path string, content string")
    assert [r.line for r in patterns.find(files, "f($A, $A)").collect()] == [1]


def test_dominators(spark):
    blocks = spark.createDataFrame([("f", "g", n, n == 0, n == 3) for n in range(5)], "file_path string, func_qn string, block_id long, is_entry boolean, is_exit boolean")
    edges = spark.createDataFrame([("f", "g", 0, 1), ("f", "g", 0, 2), ("f", "g", 1, 3), ("f", "g", 2, 3), ("f", "g", 4, 3)], "file_path string, func_qn string, from_block long, to_block long")
    found = {}
    for r in flow.dominators(blocks, edges).collect():
        found.setdefault(r.block_id, set()).add(r.dominator)
    assert found == {0: {0}, 1: {0, 1}, 2: {0, 2}, 3: {0, 3}, 4: {4}}
    post = {(r.block_id, r.dominator) for r in flow.dominators(blocks, edges, post=True).collect()}
    assert (0, 3) in post and (0, 1) not in post


def test_reaching_definitions(spark):
    events = spark.createDataFrame([("f", "g", 1, "def", "x"), ("f", "g", 2, "use", "x"), ("f", "g", 3, "def", "x"), ("f", "g", 4, "use", "x")], "file_path string, func_id string, event_id long, role string, var string")
    edges = spark.createDataFrame([("f", "g", 1, 2), ("f", "g", 2, 3), ("f", "g", 3, 4), ("f", "g", 2, 4)], "file_path string, func_id string, from_event long, to_event long")
    assert rows(flow.reaching(events, edges), "from_event", "to_event") == [(1, 2), (1, 4), (3, 4)]


def test_balanced_paths(spark):
    # Two callers of one function: the value of the first call can't come back at the second.
    edges = spark.createDataFrame(
        [(1, 10, "call_arg", 100), (2, 10, "call_arg", 200), (10, 11, "value", None), (11, 21, "call_return", 100), (11, 22, "call_return", 200)],
        "src long, dst long, kind string, call_id long",
    )
    parts = flow.call_components(edges)
    component = parts.first().component
    ends = lambda *v: spark.createDataFrame([(component, x) for x in v], "component long, node long")
    assert rows(flow.balanced_paths(parts, ends(1), ends(21, 22)), "source", "sink", "witness") == [(1, 21, "1,10,11,21")]


def test_balanced_paths_of_any_depth(spark):
    # Twelve calls inside each other, and back out of all of them.
    into = [(k, k + 1, "call_arg", 100 + k) for k in range(12)]
    out = [(12 + k, 13 + k, "call_return", 111 - k) for k in range(12)]
    parts = spark.createDataFrame([(0, *e) for e in into + out], "component long, src long, dst long, kind string, call_id long")
    ends = lambda v: spark.createDataFrame([(0, v)], "component long, node long")
    assert rows(flow.balanced_paths(parts, ends(0), ends(24)), "source", "sink", "witness") == [(0, 24, ",".join(map(str, range(25))))]
    assert rows(flow.balanced_paths(parts, ends(0), ends(24), depth=11), "source") == []


def test_summaries(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "src long, dst long")
    params = spark.createDataFrame([("f", "a", 1), ("f", "b", 4)], "func_qn string, param_name string, node long")
    got = flow.summaries(edges, params, spark.createDataFrame([("f", 3)], "func_qn string, node long"), spark.createDataFrame([(5,)], "node long"))
    assert rows(got, "param_name", "flows_to_return", "flows_to_sink") == [("a", True, False), ("b", False, True)]


def test_summaries_of_a_long_function(spark):
    n = 10_000  # every node is a parameter, so pairs of parameters and nodes would be 50 million, in as many rounds as there are nodes
    nodes = spark.range(n).select(F.lit("f").alias("func_qn"), F.col("id").cast("string").alias("param_name"), F.col("id").alias("node"))
    edges = nodes.where(F.col("node") < n - 1).select("func_qn", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    got = flow.summaries(edges, nodes, nodes.where(f"node = {n - 1}").select("func_qn", "node"), nodes.where("node = 4000").select("node"))
    assert {r[:] for r in got.collect()} == {("f", str(k), True, k <= 4000) for k in range(n)}


@pytest.mark.parametrize("named", [True, False])
def test_summaries_equal_search(spark, named):
    draw, names_of = random.Random(5), "abcdefgh"
    inside = {f: [(f"{f}{draw.randrange(12)}", f"{f}{draw.randrange(12)}") for _ in range(10)] for f in names_of}
    some = lambda k: [(f, f"{f}{draw.randrange(12)}") for f in names_of for _ in range(k)]
    params, returns, sinks = [(f, f"p{draw.randrange(4)}", n) for f, n in some(5)], some(1), some(1)
    want = {}
    for f, p, n in params:
        seen, todo = {n}, [n]
        while todo:
            a = todo.pop()
            new = {d for s, d in inside[f] if s == a} - seen
            seen |= new
            todo.extend(new)
        r, s = want.get((f, p), (False, False))
        want[f, p] = r or any((f, x) in returns for x in seen), s or any((f, x) in sinks for x in seen)
    edges = spark.createDataFrame([(f, a, b) for f, ways in inside.items() for a, b in ways] + [("a", None, "a1")], "func_qn string, src string, dst string")
    marks = spark.createDataFrame(returns, "func_qn string, node string"), spark.createDataFrame(sinks, "func_qn string, node string")
    given = (edges, marks[1]) if named else (edges.drop("func_qn"), marks[1].drop("func_qn"))
    got = flow.summaries(given[0], spark.createDataFrame(params, "func_qn string, param_name string, node string"), marks[0], given[1])
    assert rows(got, *got.columns) == sorted((*k, *v) for k, v in want.items())
    assert {v for v in want.values()} == {(a, b) for a in (True, False) for b in (True, False)}


@pytest.mark.parametrize("least", [1, 4, 100])
def test_whole_groups(least):
    keys = [None, None, "a", "b", "b", "b", "b", "b", "b", "c", "d", "d"]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + 2], "string"), "n": list(range(i, i + 2))}) for i in range(0, len(keys), 2)]
    parts = [t.to_pydict() for t in flow.whole_groups(iter([batches[0].slice(0, 0), *batches]), "k", least)]
    assert [n for t in parts for n in t["n"]] == list(range(len(keys)))
    assert all(len(t["k"]) >= least for t in parts[:-1])
    assert all(not set(a["k"]) & set(b["k"]) for i, a in enumerate(parts) for b in parts[i + 1 :])


def test_symbol_queries(files):
    symbols = python.relation(python.extracted(files), "search_symbol")
    names = lambda **kw: [n for (n,) in rows(search.query_symbols(symbols, **kw), "name")]
    assert names(kinds=["async*"]) == ["open"]
    assert names(name=["m*"]) == ["main"]
    assert names(decorators=["@app.route*"]) == ["main"]
    assert names(returns=["str"]) == ["main"]
    assert names(in_class=["Box"]) == ["open"]
    assert names(depths=["0"]) == ["Box", "main"]
    assert names(depths=["1+"]) == ["open"]
    assert names(params=["b"]) == ["main"]
    with pytest.raises(ValueError, match="depth"):
        names(depths=["x"])


def test_edits(spark, files):
    facts = python.extracted(files)
    plan = search.rename_plan(python.relation(facts, "symbol"), python.relation(facts, "reference"), "app.main", "run")
    assert rows(plan, "line", "length", "replacement") == [(9, 4, "run"), (27, 4, "run")]
    texts = spark.createDataFrame([("a", "hello world"), ("b", "xx")], "file_path string, content string")
    edits = spark.createDataFrame([("a", 0, 5, "bye"), ("a", 6, 11, "all"), ("b", 0, 2, "y"), ("b", 1, 2, "z")], "file_path string, start long, stop long, replacement string")
    assert rows(search.edited(texts, edits), "file_path", "content")[0] == ("a", "bye all")
    assert {r.file_path: r.content for r in search.edited(texts, edits).collect()}["b"] is None


def test_changed_symbols(spark):
    symbol = spark.createDataFrame([("f", "C", 1, 20), ("f", "C.m", 5, 9), ("f", "g", 30, 40)], "file_path string, qualified_name string, line long, end_line long")
    at = lambda *spans: rows(search.changed_symbols(symbol, spark.createDataFrame([("f", a, b) for a, b in spans], "file_path string, start long, stop long")), "qualified_name")
    assert at((6, 7)) == [("C.m",)] and at((12, 13), (35, 36)) == [("C",), ("g",)] and at((25, 26)) == []


def test_scan(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "node_modules" / "b.py").write_text("y = 1\n")
    (tmp_path / "src" / "c.txt").write_text("no")
    found = scan.files(spark, str(tmp_path)).select(F.element_at(F.split("file_path", "/"), -1).alias("f"), "language", "content")
    assert [tuple(r) for r in found.collect()] == [("a.py", "python", "x = 1\n")]


def edges_of(body):
    """(from, to, kind) of the one function, and the blocks that its entry reaches."""
    rows = python.facts_of("m.py", "m", "def f(a):\n" + "\n".join("    " + line for line in body.split("\n")))
    return {(f["from_block"], f["to_block"], f["edge_kind"]) for r, f in rows if r == "cfg_edge"}, {f["block_id"] for r, f in rows if r == "reachable_block"}


def test_jumps_go_through_finally():
    edges, live = edges_of("try:\n    return a\nfinally:\n    done(a)")
    assert (3, 2, "finally") in edges and (2, 1, "jump") in edges and not any(x[:2] == (3, 1) for x in edges) and 2 in live
    edges, _ = edges_of("try:\n    raise a\nfinally:\n    done(a)")
    assert {(3, 2, "finally"), (2, 1, "exception")} <= edges
    edges, _ = edges_of("for x in a:\n    try:\n        break\n    finally:\n        done(x)")
    assert (5, 4, "jump") in edges and (6, 5, "finally") in edges  # the loop is left by its finally block
    edges, _ = edges_of("try:\n    try:\n        return a\n    finally:\n        x()\nfinally:\n    y()")
    assert {(5, 4, "finally"), (4, 2, "finally"), (2, 1, "jump")} <= edges


def test_references_know_their_block_and_events_reach():
    source = "def f(a):\n    x = 1\n    if a:\n        x = g(a)\n    return x._y\nz = f(2)\n"
    rows = python.facts_of("m.py", "m", source)
    of = lambda name: [f for r, f in rows if r == name]
    assert {f["block_id"] for f in of("call") if f["callee_qn"] == "m.g"} == {2}
    assert [f["symbol_qn"] for f in of("module_level_ref")] == ["m.z", "m.f"] or {f["symbol_qn"] for f in of("module_level_ref")} == {"m.z", "m.f"}
    assert [f["member_name"] for f in of("noncall_private_member_ref")] == ["_y"]
    role = {f["event_id"]: (f["role"], f["var"], f["start_line"]) for f in of("flow_event")}
    reaching = {(role[f["from_event"]], role[f["to_event"]]) for f in of("flow_edge") if f["edge_kind"] == "reaching"}
    assert {(("def", "x", 2), ("use", "x", 5)), (("def", "x", 4), ("use", "x", 5)), (("param_in", "a", 1), ("use", "a", 4))} <= reaching


def test_fuzzy_match_replaces_characters(spark):
    rows = spark.createDataFrame([("ab",), ("axb",), ("abc",), ("zabx",), ("a",)], "name string")
    got = {r.name: r.hit for r in rows.select("name", names.fuzzy_subsequence(F.col("name"), "abx").alias("hit")).collect()}
    assert got == {"ab": False, "axb": False, "abc": True, "zabx": True, "a": False}


def test_store_carries_other_relations_and_orders_mirrors(spark, tmp_path):
    facts = FactStore(spark, str(tmp_path))
    call = spark.createDataFrame([(f"a{k % 7}", f"b{k % 5}", "f.py", k, 0, None, None) for k in range(60)], RELATIONS["call"])
    facts.publish({"call": call, "file_namespace": spark.createDataFrame([("f.py", "python")], RELATIONS["file_namespace"])})
    before = facts._where()
    facts.upsert({"file_namespace": spark.createDataFrame([("g.py", "rust")], RELATIONS["file_namespace"])})
    after = facts._where()
    assert before["call"][1] == after["call"][1] and before["file_namespace"][1] != after["file_namespace"][1]
    assert facts.table("file_namespace").count() == 2 and facts.table("call").count() == facts.table("call_by_callee").count() == 60
    first = [r.callee_qn for r in facts.table("call_by_callee").coalesce(1).collect()]
    assert set(first) == {f"b{k}" for k in range(5)}

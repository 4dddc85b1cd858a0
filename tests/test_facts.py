"""Operators on the small graph: two files, three functions, a class and a method."""

import random

import pytest
from pyspark.sql import functions as F

from factweave import schema
from factweave.functions import names
from factweave.operators import checks, clones, dsl, ranges, recursive, relational
from factweave.sources import scan
from factweave.sources.store import FactStore, tagged_json
from factweave.streaming import state


@pytest.fixture(scope="module")
def graph(spark):
    symbol = spark.createDataFrame(
        [
            ("app.main", "app.py", "main", "function", 1, 5, None),
            ("app.helper", "app.py", "helper", "function", 7, 10, None),
            ("lib.compute", "lib.py", "compute", "function", 1, 8, None),
            ("lib.MyClass", "lib.py", "MyClass", "class", 10, 20, None),
            ("lib.MyClass.method", "lib.py", "method", "method", 11, 15, "lib.MyClass"),
        ],
        schema.RELATIONS["symbol"],
    )
    call = spark.createDataFrame(
        [("app.main", "app.helper", "app.py", 3, 4, None, None), ("app.main", "lib.compute", "app.py", 4, 4, None, None), ("app.helper", "lib.compute", "app.py", 8, 4, None, None)],
        schema.RELATIONS["call"],
    )
    reference = spark.createDataFrame(
        [("lib.compute", "app.py", 4, 4, "call", None, None), ("lib.compute", "app.py", 8, 4, "call", None, None), ("lib.MyClass", "app.py", 2, 0, "import", None, None)],
        schema.RELATIONS["reference"],
    )
    return {"symbol": symbol, "call": call, "reference": reference}


def column(df, name=None):
    return sorted(r[name or 0] for r in df.collect())


def test_filters_and_calls(graph):
    assert column(relational.matching(graph["symbol"], kind="function", file_path="app.py")) == ["app.helper", "app.main"]
    assert column(relational.matching(graph["symbol"], kind="class")) == ["lib.MyClass"]
    assert column(relational.matching(graph["call"], caller_qn="app.main"), "callee_qn") == ["app.helper", "lib.compute"]
    assert column(relational.matching(graph["call"], callee_qn="lib.compute"), "caller_qn") == ["app.helper", "app.main"]


def test_closures(graph):
    assert column(recursive.transitive_callers(graph["call"], "lib.compute")) == ["app.helper", "app.main"]
    assert column(recursive.transitive_callees(graph["call"], "app.main")) == ["app.helper", "lib.compute"]


def test_unreferenced(graph):
    found = column(relational.unreferenced(graph["symbol"], graph["reference"]))
    assert "app.main" in found and "app.helper" in found and "lib.compute" not in found and "lib.MyClass" not in found


def test_impact(spark, graph):
    changed = spark.createDataFrame([("lib.compute",)], "qn string")
    assert {r.caller_qn for r in recursive.impact_edges(graph["call"], changed).collect()} == {"app.main", "app.helper"}
    assert recursive.impact_edges(graph["call"], changed, 0).count() == 0
    chain = spark.createDataFrame([("a.a", "b.b"), ("b.b", "c.c")], "caller_qn string, callee_qn string")
    assert len(recursive.impact_edges(chain, spark.createDataFrame([("c.c",)], "qn string")).collect()) == 2


def test_cascade(spark):
    call = spark.createDataFrame([("a.caller", "b.callee")], "caller_qn string, callee_qn string")
    gone = spark.createDataFrame([("a.caller",)], "qn string")
    assert column(relational.cascade_dead(call, gone)) == ["b.callee"]
    more = call.union(spark.createDataFrame([("x.other", "b.callee")], call.schema))
    assert column(relational.cascade_dead(more, gone)) == []


def test_dead_code_reports_roots_and_causes(spark):
    names_ = "root other branch cycle loop shared callback island1 island2".split()
    symbol = spark.createDataFrame([(n, "a.py", n, "function", 1, 2, None) for n in names_], schema.RELATIONS["symbol"])
    pairs = [("root", "branch"), ("root", "cycle"), ("cycle", "loop"), ("loop", "cycle"), ("root", "shared"), ("other", "shared"), ("island1", "island2"), ("island2", "island1")]
    refs = spark.createDataFrame([("a.py", a, 0, b) for a, b in pairs], schema.RELATIONS["ref_by_block"])
    live = refs.select("file_path", "func_qn", "block_id").distinct()
    module = spark.createDataFrame([("callback", "a.py", 9)], schema.RELATIONS["module_level_ref"])
    entries = recursive.entry_points(symbol, spark.createDataFrame([], schema.RELATIONS["decorator_on"]), spark.createDataFrame([], schema.RELATIONS["exported_symbol"]))
    found = {r.qn: r.causes for r in recursive.dead_code(symbol, refs, live, module, entries).collect()}
    assert found == {"root": "", "other": "", "branch": "root", "cycle": "root", "loop": "root", "shared": "other,root"}


def test_rounds_equal_search(spark, monkeypatch):
    random.seed(4)
    edges = spark.createDataFrame([(random.randrange(30), random.randrange(30)) for _ in range(50)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1), (2, 7)], "root long, node long")
    small = recursive.reachable(edges, seeds, carry=("root",)).collect()
    monkeypatch.setattr(recursive, "SMALL_EDGES", -1)
    assert sorted(small) == sorted(recursive.reachable(edges, seeds, carry=("root",)).collect())


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 5)], "src long, dst long")
    assert {r.node: r.component for r in recursive.components(edges).collect()} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}


def test_ranges(spark):
    inner = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 10, 20, "inner")], "k string, a long, b long, name string")
    points = spark.createDataFrame([("f", 15), ("f", 50), ("f", 500), ("g", 1)], "k string, spot long")
    got = {(r.k, r.spot): r.name for r in ranges.innermost(points, inner, "k", "spot", "a", "b", [F.col("name")]).collect()}
    assert got == {("f", 15): "inner", ("f", 50): "outer", ("f", 500): None, ("g", 1): None}
    prefixes = spark.createDataFrame([("a", 1), ("a.b", 2)], "prefix string, v long")
    modules = spark.createDataFrame([("a.b.c",), ("a.bc",), ("z",)], "m string")
    assert {r.m: r.v for r in ranges.longest_prefix(modules, prefixes, "m", "prefix").collect()} == {"a.b.c": 2, "a.bc": 1, "z": None}
    spans = spark.createDataFrame([("f", 1, 5), ("f", 5, 8), ("f", 10, 12), ("f", 3, 4)], "k string, start long, stop long")
    assert sorted((r.start, r.stop) for r in ranges.merged(spans, "k").collect()) == [(1, 8), (10, 12)]


def test_union_of_repeated_intervals(spark):
    spans = [("f", 1, 4), ("f", 10, 11), ("f", 10, 13), ("f", 20, 22), ("g", 1, 2)]
    repeated = spark.createDataFrame(spans * 50, "k string, start long, stop long").repartition(8)
    assert sorted((r.k, r.start, r.stop) for r in ranges.merged(repeated, "k").collect()) == [("f", 1, 4), ("f", 10, 13), ("f", 20, 22), ("g", 1, 2)]


def test_many_ranges_of_small_files_are_not_broadcast(spark):
    wide = spark.range(ranges.BROADCAST_ROWS + 1).select(F.lit("f").alias("k"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + 4).alias("b"), F.col("id").alias("name"))
    points = spark.createDataFrame([("f", 0), ("f", 7), ("f", 9), ("f", 10**9), ("g", 1)], "k string, spot long")
    got = ranges.innermost(points, wide, "k", "spot", "a", "b", [F.col("name")])
    assert {(r.k, r.spot): r.name for r in got.collect()} == {("f", 0): 0, ("f", 7): 2, ("f", 9): 3, ("f", 10**9): None, ("g", 1): None}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_translated_lines_equal_simulation(spark):
    hunks = spark.createDataFrame([("f", 3, 2, 5), ("f", 8, 0, 1), ("f", 10, 1, 0)], "file_path string, old_start long, old_count long, new_count long")
    lines = spark.createDataFrame([("f", n) for n in range(1, 13)], "file_path string, line long")
    got = {r.line: r.new_line for r in ranges.translated(lines, hunks).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None, 5: 8, 6: 9, 7: 10, 8: 11, 9: 13, 10: None, 11: 14, 12: 15}


@pytest.mark.parametrize(
    ("texts", "expected"),
    [({"a": "a" * 50, "b": "a" * 50}, [(50, 2)]), ({"a": "a" * 50}, [(25, 2)]), ({"a": "abcdWXYZ", "b": "WXYZabcd"}, [(4, 2), (4, 2)])],
)
def test_maximal_runs(texts, expected):
    assert [(n, len(p)) for n, p in clones.maximal_runs({k: list(v) for k, v in texts.items()}, 4)] == expected


def test_names(spark):
    df = spark.createDataFrame([("'../pkg'::Thing/method", "getHTTPValue")], "qn string, name string")
    row = df.select(names.normalized(F.col("qn")).alias("q"), names.words(F.col("name")).alias("w")).first()
    assert row.q == "pkg.Thing.method" and row.w == ["get", "http", "value"]
    paths = spark.createDataFrame([("src/a/b.py",), ("src/b.py",), ("lib/test_x.py",)], "p string")
    assert column(paths.where(F.col("p").rlike(names.path_glob_regex("src/**/*.py")))) == ["src/a/b.py", "src/b.py"]
    assert column(paths.where(F.col("p").rlike(names.path_glob_regex("src")))) == ["src/a/b.py", "src/b.py"]
    assert column(paths.where(names.is_test_file(F.col("p")))) == ["lib/test_x.py"]
    assert names.pattern_words("requests.get($URL, timeout=$...T)") == ["get", "requests", "timeout"]


def test_dsl(spark):
    df = spark.createDataFrame([("SELECT a FROM Users u JOIN orders o",), ("{{ user }} hi",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(dsl.region_kind(F.col("t"))).collect()] == ["sql", "jinja", None, None]
    assert df.select(dsl.sql_tables(F.col("t"))).first()[0] == ["orders", "users"]
    lines = spark.createDataFrame([(1, 1, "x = foo(a, a)"), (1, 2, "x = foo(a, b)")], "id long, line long, line_text string")
    assert column(dsl.grep(lines, dsl.pattern_regex("foo($A, $A)")), "line") == [1]
    assert [r.line_text for r in dsl.rewritten(lines, [(r"foo\((\w+), (\w+)\)", r"bar(\1)")]).collect()] == ["x = bar(a)", "x = bar(a)"]
    classes = spark.createDataFrame([("User", "users"), ("Category", None)], "class string, table_name string")
    tables = spark.createDataFrame([("users",), ("categories",), ("none",)], "table string")
    assert sorted((r.table, r["class"], r.confidence) for r in dsl.orm_links(tables, classes).collect()) == [("categories", "Category", 0.8), ("users", "User", 0.95)]


def test_near_clones(spark):
    a = [f"t{k}" for k in range(40)]
    b = [*a[:20], "x", *a[21:]]
    bodies = spark.createDataFrame([(1, a), (2, b), (3, ["z"] * 40)], "id long, tokens array<string>")
    pairs = clones.shared_shingles(clones.shingles(bodies, "id", "tokens"))
    assert [(r.left, r.right, r.regions, r.changed) for r in clones.near_clones(pairs, bodies).collect()] == [(1, 2, 1, 1)]


def test_overlays(spark):
    rows = [(1, "a.py", "e", 1, "one"), (2, "a.py", "e", 3, "three"), (3, "a.py", "e", 2, "late"), (4, "a.py", "x", 0, "other"), (5, "b.py", "e", 0, "b"), (6, "b.py", "e", 0, "b2")]
    updates = spark.createDataFrame(rows, "seq long, file_path string, owner string, version long, content string")
    assert {r.file_path: r.content for r in state.overlay_fold(updates).collect()} == {"a.py": "other", "b.py": "b"}


def test_overlay_stream_equals_fold(spark, tmp_path):
    rows = [(1, "a.py", "e", 1, "one"), (2, "a.py", "e", 3, "three"), (3, "a.py", "e", 2, "late")]
    updates = spark.createDataFrame(rows, "seq long, file_path string, owner string, version long, content string")
    updates.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.overlay_stream(spark.readStream.schema(updates.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("overlays").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.content for r in spark.table("overlays").collect()) == ["one", "three"]


def test_store_round_trip(spark, graph, tmp_path):
    store = FactStore(spark, str(tmp_path))
    assert store.table("symbol").count() == 0
    store.publish(graph)
    assert store.table("call_by_callee").count() == 3
    gone = spark.createDataFrame([("app.py",)], "file_path string")
    new = graph["symbol"].where("file_path = 'app.py'").limit(1).withColumn("name", F.lit("renamed"))
    store.replace_files(gone, {"symbol": new})
    assert store.table("call").count() == 0 and "renamed" in column(store.table("symbol"), "name")
    facts = tagged_json({"symbol": store.table("symbol")})
    assert sorted(map(tuple, store.from_json(facts)["symbol"].collect())) == sorted(map(tuple, store.table("symbol").collect()))


def test_diff_hunks(spark):
    text = ["--- a/x.py", "+++ b/x.py", "@@ -3,2 +3,5 @@", "@@ -9 +12,0 @@", "+++ b/y.py", "@@ -1,0 +2 @@"]
    df = spark.createDataFrame([(1, n, line) for n, line in enumerate(text)], "diff_id long, n long, line string")
    got = [tuple(r)[1:] for r in scan.diff_hunks(df).orderBy("file_path", "old_start").collect()]
    assert got == [("x.py", 3, 2, 3, 5), ("x.py", 9, 1, 12, 0), ("y.py", 1, 0, 2, 1)]


def test_flow_stops_at_sanitizers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (6, 3)], "src long, dst long")
    node = lambda *v: spark.createDataFrame([(x,) for x in v], "node long")
    assert sorted(map(tuple, checks.flow_violations(edges, node(1, 6), node(4), node(3)).collect())) == [(1, 4)]

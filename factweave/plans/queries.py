"""Queries over the shared tables, one or more for each operator, each with equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import names
from factweave.operators import checks, clones, dsl, ranges, recursive, relational, search
from factweave.plans.views import Facts, with_views
from factweave.sources import scan, store
from factweave.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register a function of Facts under its name, with its SQL over the named views."""

    def add(fn: Callable[[Facts], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Facts(spark, sf_dir))
        if sql:
            SQL[fn.__name__] = with_views(views, sql) if views else sql
        return fn

    return add


def ids(f: Facts, column: str, *values: str) -> DataFrame:
    return f.spark.createDataFrame([(v,) for v in values], f"{column} string")


# -- filters and projections ------------------------------------------------
@query("select qualified_name, file_path, name, line from symbol where kind = 'function' and file_path = 'f7.py'", "symbol")
def symbols_filter(f: Facts) -> DataFrame:
    return relational.matching(f.symbol, kind="function", file_path="f7.py").select("qualified_name", "file_path", "name", "line")


@query("select * from call where caller_qn = 's3'", "call")
def calls_from(f: Facts) -> DataFrame:
    return relational.matching(f.call, caller_qn="s3")


@query("select * from call where callee_qn = 's3'", "call")
def calls_to(f: Facts) -> DataFrame:
    return relational.matching(f.call, callee_qn="s3")


@query("select * from reference where symbol_qn = 's4' and ref_kind = 'write'", "reference")
def refs_by_kind(f: Facts) -> DataFrame:
    return relational.references(f.reference, "s4", writes_only=True)


@query("select * from reference where symbol_qn = 's4' and ref_kind not in ('definition', 'import')", "reference")
def refs_in_use(f: Facts) -> DataFrame:
    return relational.references(f.reference, "s4", definition=False, imports=False)


@query("select distinct caller_qn, callee_qn from call where file_path = 'f3.py'", "call")
def graph_edges(f: Facts) -> DataFrame:
    return relational.graph_edges(f.call, "f3.py")


@query("select imported_module, nullif(imported_name, '') as imported_name, line from import_ where importing_file = 'f9.py'", "import_")
def imports_in(f: Facts) -> DataFrame:
    rows = relational.matching(f.import_, importing_file="f9.py")
    return rows.select("imported_module", F.nullif("imported_name", F.lit("")).alias("imported_name"), "line")


@query("select distinct importing_file from import_ where imported_module = 'pkg.f12'", "import_")
def importing_files(f: Facts) -> DataFrame:
    return relational.matching(f.import_, imported_module="pkg.f12").select("importing_file").distinct()


@query("select * from cfg_edge where func_qn = 'conv5'", "cfg_edge")
def cfg_edges(f: Facts) -> DataFrame:
    return relational.matching(f.cfg_edge, func_qn="conv5")


@query("select * from def_use where func_qn = 's5' and var_name = 'v2'", "def_use")
def def_uses(f: Facts) -> DataFrame:
    return relational.matching(f.def_use, func_qn="s5", var_name="v2")


@query("select symbol_qn, decorator from decorator_on where regexp_matches(decorator, '^App')", "decorator_on")
def decorators_like(f: Facts) -> DataFrame:
    return f.decorator_on.where(F.col("decorator").rlike("^App")).select("symbol_qn", "decorator")


@query("select qualified_name, name from symbol where name like 'part%1' or regexp_matches(name, '^_p.?1$')", "symbol")
def glob_filter(f: Facts) -> DataFrame:
    n = F.col("name")
    return f.symbol.where(names.glob_match(n, "part*1") | names.glob_match(n, "/^_p.?1$/")).select("qualified_name", "name")


@query("select qualified_name from symbol where lower(name) in ('supplier_000000003', 'supplier000000003')", "symbol")
def smart_case(f: Facts) -> DataFrame:
    return f.symbol.where(F.col("name").rlike(names.smart_case_regex("supplier_000000003"))).select("qualified_name")


@query("select qualified_name, line, end_line - line as span from symbol where parent in ('s1', 's2') and kind = 'method'", "symbol")
def in_class_filter(f: Facts) -> DataFrame:
    return search.query_symbols(f.symbol, kinds=["method"], in_class=["s1", "s2"]).select("qualified_name", "line", (F.col("end_line") - F.col("line")).alias("span"))


@query("select qualified_name, name from symbol where regexp_matches(name, '^(test_|Test)')", "symbol")
def test_symbols(f: Facts) -> DataFrame:
    return f.symbol.where(names.is_test_symbol(F.col("name"))).select("qualified_name", "name")


@query("select distinct file_path, type_str from type_binding where type_str = 'lib.T1' or (type_str <> 'lib.T2' and type_str = 'lib.T3')", "type_binding")
def type_constraint(f: Facts) -> DataFrame:
    return f.type_binding.where(names.type_matches(F.col("type_str"), "T1|!T2&lib.T3")).select("file_path", "type_str").distinct()


@query("select distinct file_path from symbol where regexp_matches(file_path, '^f1[^/]*\\.py$')", "symbol")
def path_glob(f: Facts) -> DataFrame:
    return f.symbol.where(F.col("file_path").rlike(names.path_glob_regex("f1*.py"))).select("file_path").distinct()


@query("select qualified_name, list_aggregate(list_filter(string_split_regex(lower(name), '_+'), lambda x: x <> ''), 'string_agg', ' ') as words from symbol where kind = 'class'", "symbol")
def identifier_words(f: Facts) -> DataFrame:
    return f.symbol.where("kind = 'class'").select("qualified_name", F.array_join(names.words(F.col("name")), " ").alias("words"))


# -- joins and anti joins ---------------------------------------------------
@query("select caller_qn, callee_qn, namespace, count(*) as n from call join file_namespace using (file_path) group by all", "call file_namespace")
def namespaced_calls(f: Facts) -> DataFrame:
    return relational.namespaced(f.call, f.file_namespace).groupBy("caller_qn", "callee_qn", "namespace").agg(F.count("*").alias("n"))


@query(
    """select distinct m.file_path, m.func_qn, m.receiver, m.method, t.type_str
       from method_call m join def_use d on d.file_path = m.file_path and d.func_qn = m.func_qn and d.var_name = m.receiver and d.use_block = m.block_id
       join type_binding t on t.file_path = m.file_path and t.symbol_qn = m.receiver and t.line = d.def_line""",
    "method_call def_use type_binding",
)
def receiver_type_join(f: Facts) -> DataFrame:
    return relational.receiver_types(f.method_call, f.def_use, f.type_binding)


@query("select qualified_name, kind from symbol s where not exists (select 1 from reference r where r.symbol_qn = s.qualified_name and ref_kind <> 'definition')", "symbol reference")
def dead_code_simple(f: Facts) -> DataFrame:
    return relational.unreferenced(f.symbol, f.reference).select("qualified_name", "kind")


@query(
    """select qualified_name from symbol s
       where qualified_name not in ('s1', 's2', 's3')
         and not exists (select 1 from call c where c.callee_qn = s.qualified_name and c.caller_qn not in ('s1', 's2', 's3'))
         and not exists (select 1 from reference r where r.symbol_qn = s.qualified_name and r.ref_kind <> 'definition'
                           and not exists (select 1 from call c where c.callee_qn = r.symbol_qn))""",
    "symbol call reference",
)
def unreferenced_excluding(f: Facts) -> DataFrame:
    return relational.unreferenced_without(f.symbol, f.call, f.reference, ids(f, "qn", "s1", "s2", "s3")).select("qualified_name")


@query(
    """select distinct callee_qn as qn from call c where caller_qn in ('s1', 's2') and callee_qn not in ('s1', 's2')
       and not exists (select 1 from call o where o.callee_qn = c.callee_qn and o.caller_qn not in ('s1', 's2'))""",
    "call",
)
def cascade_dead(f: Facts) -> DataFrame:
    return relational.cascade_dead(f.call, ids(f, "qn", "s1", "s2"))


@query("select qualified_name from symbol s where not exists (select 1 from call where caller_qn = s.qualified_name or callee_qn = s.qualified_name)", "symbol call")
def isolated_symbols(f: Facts) -> DataFrame:
    return relational.isolated(f.symbol, f.call).select("qualified_name")


@query("select distinct r.file_path, r.func_qn, r.symbol_qn from ref_by_block r join reachable_block b using (file_path, func_qn, block_id)", "ref_by_block reachable_block")
def live_references(f: Facts) -> DataFrame:
    return f.ref_by_block.join(f.reachable_block, ["file_path", "func_qn", "block_id"], "left_semi").select("file_path", "func_qn", "symbol_qn").distinct()


@query(
    """select distinct d.file_path, d.func_qn, d.var_name, d.def_line, u.use_line from (select distinct file_path, func_qn, var_name, def_line from def_use) d
       join (select distinct file_path, func_qn, var_name, use_line from def_use) u using (file_path, func_qn, var_name)""",
    "def_use",
)
def def_use_pairs(f: Facts) -> DataFrame:
    key = ("file_path", "func_qn", "var_name")
    return relational.def_use_pairs(f.def_use.select(*key, "def_line").distinct(), f.def_use.select(*key, "use_line").distinct())


# -- recursion ---------------------------------------------------------------
_REACH = "seen(node) as (select '{0}' union select c.{2} from seen s join call c on c.{1} = s.node) select node as qn from seen where node <> '{0}'"


@query(", " + _REACH.format("s3", "callee_qn", "caller_qn"), "call")
def transitive_callers(f: Facts) -> DataFrame:
    return recursive.transitive_callers(f.call, "s3")


@query(", " + _REACH.format("s3", "caller_qn", "callee_qn"), "call")
def transitive_callees(f: Facts) -> DataFrame:
    return recursive.transitive_callees(f.call, "s3")


@query(
    """, live(file_path, func_qn, block_id) as (
         select file_path, func_qn, block_id from cfg_block where is_entry
         union select e.file_path, e.func_qn, e.to_block from live l join cfg_edge e on e.file_path = l.file_path and e.func_qn = l.func_qn and e.from_block = l.block_id)
       select file_path, func_qn, block_id from cfg_block b where not is_exit
         and not exists (select 1 from live l where l.file_path = b.file_path and l.func_qn = b.func_qn and l.block_id = b.block_id)""",
    "cfg_block cfg_edge",
)
def unreachable_blocks(f: Facts) -> DataFrame:
    return recursive.unreachable_blocks(f.cfg_block, f.cfg_edge)


@query(
    """, l0 as (select distinct caller_qn as qn from call where callee_qn in ('p7', 'p8', 's1')),
       l1 as (select distinct caller_qn as qn from call where callee_qn in (select qn from l0)),
       near as (select qn from l0 union select qn from l1)
       select distinct caller_qn, callee_qn from call where (callee_qn in ('p7', 'p8', 's1') or callee_qn in (select qn from near)) and caller_qn not in ('p7', 'p8', 's1')""",
    "call",
)
def impact_depth_3(f: Facts) -> DataFrame:
    return recursive.impact_edges(f.call, ids(f, "qn", "p7", "p8", "s1"), 3)


_DEAD = """
, entry as (
    select qualified_name as qn from symbol where (starts_with(name, '__') and ends_with(name, '__')) or name in ('main') or starts_with(name, 'test_')
    union select qualified_name from exported_symbol union select symbol_qn from decorator_on where lower(decorator) = 'app.route'),
edge as (
    select distinct r.func_qn as src, r.symbol_qn as dst from ref_by_block r join reachable_block b using (file_path, func_qn, block_id) where r.func_qn <> r.symbol_qn),
outer_ref as (select distinct symbol_qn as qn from module_level_ref),
eligible as (select distinct qualified_name as qn from symbol where parent is null and qualified_name not in (select qn from entry)),
root as (select qn from eligible where qn not in (select dst from edge) and qn not in (select qn from outer_ref)),
candidate(qn) as (select qn from root union select e.dst from candidate c join edge e on e.src = c.qn where e.dst in (select qn from eligible)),
kept(qn) as (
    select c.qn from candidate c where c.qn in (select qn from outer_ref) or c.qn in (select dst from edge where src not in (select qn from candidate))
    union select e.dst from kept k join edge e on e.src = k.qn where e.dst in (select qn from candidate)),
unused as (select qn from candidate where qn not in (select qn from kept)),
cause(root, qn) as (select qn, qn from root union select c.root, e.dst from cause c join edge e on e.src = c.qn where e.dst in (select qn from unused))
"""


def _entries(f: Facts) -> DataFrame:
    return recursive.entry_points(f.symbol, f.decorator_on, f.exported_symbol, ["app.route"], ["main"], ["test_"])


@query(_DEAD + "select qn from entry", "symbol exported_symbol decorator_on ref_by_block reachable_block module_level_ref")
def entry_points(f: Facts) -> DataFrame:
    return _entries(f)


@query(
    _DEAD + "select qn, '' as causes from root union all select qn, string_agg(root, ',' order by root) from cause where qn not in (select qn from root) group by qn",
    "symbol exported_symbol decorator_on ref_by_block reachable_block module_level_ref",
)
def dead_code_unified(f: Facts) -> DataFrame:
    f.keep("call")
    return recursive.dead_code(f.symbol, f.ref_by_block, f.reachable_block, f.module_level_ref, _entries(f))


@query()
def call_components(f: Facts) -> DataFrame:
    """Components over every call; without SQL, as a recursive union lists every pair of a component's nodes."""
    return recursive.components(f.call.select(F.col("caller_qn").alias("src"), F.col("callee_qn").alias("dst")))


# -- ranges -------------------------------------------------------------------
@query(
    """select c.file_path, c.caller_qn, c.line, (select t.type_str from type_binding t where t.file_path = c.file_path and t.symbol_qn = 'v1' and t.line <= c.line + 1
          order by t.line desc, t.type_str desc limit 1) as type_str
       from (select distinct file_path, caller_qn, line from call) c""",
    "call type_binding",
)
def latest_type_asof(f: Facts) -> DataFrame:
    at = f.call.select("file_path", "caller_qn", "line").distinct().withColumn("at", F.col("line") + 1)
    types = f.type_binding.where("symbol_qn = 'v1'").groupBy("file_path", F.col("line").alias("bound")).agg(F.max("type_str").alias("type_str"))
    return ranges.as_of(at, types, ["file_path"], "at", "bound", ["type_str"]).drop("at")


@query(
    """select event_id, user_id, (select p.event_id from events p where p.user_id = e.user_id and p.event_type = 'click' and p.ts <= e.ts order by p.ts desc, p.event_id desc limit 1) as click_id
       from events e where event_type = 'purchase'"""
)
def event_asof(f: Facts) -> DataFrame:
    clicks = f.events.where("event_type = 'click'").groupBy("user_id", F.col("ts").alias("click_ts")).agg(F.max("event_id").alias("click_id"))
    bought = f.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return ranges.as_of(bought, clicks, ["user_id"], "ts", "click_ts", ["click_id"]).drop("ts")


@query(
    """select file_path, spot, qualified_name from (
         select p.file_path, p.spot, s.qualified_name, row_number() over (partition by p.file_path, p.spot order by s.end_line - s.line, s.line desc, s.qualified_name desc) as n
         from (select distinct file_path, line * 37 as spot from call) p left join symbol s on s.file_path = p.file_path and p.spot between s.line and s.end_line) x where n = 1""",
    "call symbol",
)
def innermost_range(f: Facts) -> DataFrame:
    points = f.call.select("file_path", (F.col("line") * 37).alias("spot")).distinct()
    inner = f.symbol.select("file_path", "line", "end_line", "qualified_name")
    return ranges.innermost(points, inner, "file_path", "spot", "line", "end_line", [F.col("line"), F.col("qualified_name")]).select("file_path", "spot", "qualified_name")


@query(
    """, prefix as (select distinct 'pkg.f' || cast(k as string) as prefix, k as target from (select p_size as k from part) a),
       name as (select distinct imported_module || case when imported_name = '' then '' else '.' || imported_name end as module from import_)
       select module, (select p.prefix from prefix p where module = p.prefix or starts_with(module, p.prefix || '.') order by length(p.prefix) desc limit 1) as prefix from name""",
    "import_",
)
def longest_prefix(f: Facts) -> DataFrame:
    modules = f.import_.select(F.concat("imported_module", F.when(F.col("imported_name") == "", "").otherwise(F.concat(F.lit("."), "imported_name"))).alias("module")).distinct()
    prefixes = f.part.select(F.concat(F.lit("pkg.f"), F.col("p_size").cast("string")).alias("prefix"), F.col("p_size").alias("target")).distinct()
    return ranges.longest_prefix(modules, prefixes, "module", "prefix").select("module", "prefix")


@query(
    """, a as (select file_path, line as start, end_line + 1 as stop from symbol),
       b as (select distinct file_path, line * 41 as r_start, line * 41 + 9 as r_stop from call)
       select file_path, start, stop, r_start, r_stop from a join b using (file_path) where start < r_stop and r_start < stop""",
    "symbol call",
)
def interval_overlap(f: Facts) -> DataFrame:
    a = f.symbol.select("file_path", F.col("line").alias("start"), (F.col("end_line") + 1).alias("stop"))
    b = f.call.select("file_path", (F.col("line") * 41).alias("r_start"), (F.col("line") * 41 + 9).alias("r_stop")).distinct()
    return ranges.overlapping(a, b, "file_path")


@query(
    """, x as (select file_path, line as start, end_line + 1 as stop from symbol),
       y as (select *, case when max(stop) over (partition by file_path order by start, stop rows between unbounded preceding and 1 preceding) >= start then 0 else 1 end as fresh from x),
       z as (select *, sum(fresh) over (partition by file_path order by start, stop rows unbounded preceding) as g from y)
       select file_path, min(start) as start, max(stop) as stop from z group by file_path, g""",
    "symbol",
)
def interval_union(f: Facts) -> DataFrame:
    return ranges.merged(f.symbol.select("file_path", F.col("line").alias("start"), (F.col("end_line") + 1).alias("stop")), "file_path")


@query(
    """, f as (select distinct file_path, line, case when col % 2 = 0 then 'r1' else 'r2' end as rule from call),
       s as (select file_path, line % 7 as a, line % 7 + 1 as b, case when kind = 'class' then null else 'r1' end as tag from symbol)
       select * from f where not exists (select 1 from s where s.file_path = f.file_path and f.line between s.a and s.b and (s.tag is null or s.tag = f.rule))""",
    "call symbol",
)
def noqa_suppressed(f: Facts) -> DataFrame:
    found = f.call.select("file_path", "line", F.when(F.col("col") % 2 == 0, "r1").otherwise("r2").alias("rule")).distinct()
    tags = F.when(F.col("kind") == "class", F.lit(None)).otherwise(F.array(F.lit("r1")))
    return ranges.suppressed(found, f.symbol.select("file_path", (F.col("line") % 7).alias("start"), (F.col("line") % 7 + 1).alias("end"), tags.alias("tags")))


# -- aggregates, sorts, top-k ---------------------------------------------------
@query("select name, count(distinct qualified_name) as n_symbols from symbol group by name", "symbol")
def name_multiplicity(f: Facts) -> DataFrame:
    return relational.name_counts(f.symbol)


@query("select callee_qn, string_agg(distinct caller_qn, ',' order by caller_qn) as callers from call group by callee_qn", "call")
def callers_collect(f: Facts) -> DataFrame:
    return f.call.groupBy("callee_qn").agg(F.array_join(F.sort_array(F.collect_set("caller_qn")), ",").alias("callers"))


@query(
    "select caller_qn, count(distinct callee_qn) as fan_out, case when count(distinct callee_qn) >= 10 then 'high' when count(distinct callee_qn) >= 5 then 'medium' else 'low' end as danger from call group by 1",
    "call",
)
def fan_out_danger(f: Facts) -> DataFrame:
    return checks.danger(f.call)


@query(
    """, r as (select 'unreferenced' as rule, 'warning' as severity, file_path, line, cast(0 as bigint) as col, 'never used' as message from symbol s
                where not exists (select 1 from reference r where r.symbol_qn = s.qualified_name and ref_kind <> 'definition')
              union all select 'write', 'error', file_path, line, col, '' from reference where ref_kind = 'write')
       select * from r""",
    "symbol reference",
)
def violations_union(f: Facts) -> DataFrame:
    unused = checks.violations(relational.unreferenced(f.symbol, f.reference), "unreferenced", "warning", "never used")
    return checks.union(unused, checks.violations(f.reference.where("ref_kind = 'write'"), "write", "error"))


@query(
    """select severity, count(*) as n from (
         select 'warning' as severity from symbol s where not exists (select 1 from reference r where r.symbol_qn = s.qualified_name and ref_kind <> 'definition')
         union all select 'error' from reference where ref_kind = 'write') x group by 1""",
    "symbol reference",
)
def severity_counts(f: Facts) -> DataFrame:
    return relational.severity_counts(violations_union(f))


@query(
    """select qualified_name, name, score from (select qualified_name, name, case when lower(name) = 'plat' then 1000.0 when starts_with(lower(name), 'plat') then 900.0
         when regexp_matches(lower(name), '_plat') then 800.0 when contains(name, 'plat') then 700.0 when contains(lower(name), 'plat') then 600.0
         when contains(lower(qualified_name), 'plat') then 400.0 else 0.0 end as score from symbol) x where score > 200 order by score desc, length(name), name, qualified_name limit 25""",
    "symbol",
)
def symbol_rank_topk(f: Facts) -> DataFrame:
    score = names.symbol_score(F.col("name"), F.col("qualified_name"), "plat")
    sized = f.symbol.withColumn("_n", F.length("name"))
    return relational.top(sized, score, ["_n", "name", "qualified_name"], 25).select("qualified_name", "name", "score")


@query(
    """select file_path, score from (select distinct file_path, case when file_path = 'f1' then 1100.0 when file_path = 'f1.py' then 1080.0 when starts_with(file_path, 'f1') then 1050.0
         when contains(file_path, 'f1') then 300.0 else 0.0 end as score from symbol) x where score > 0 order by score desc, file_path limit 10""",
    "symbol",
)
def file_rank_topk(f: Facts) -> DataFrame:
    return relational.top(f.symbol.select("file_path").distinct(), names.file_score(F.col("file_path"), "f1"), ["file_path"], 10).select("file_path", "score")


# -- clones and text --------------------------------------------------------------
@query(
    """select lang as language, sha256(coalesce(text, '')) as hash, count(*) as size, count(distinct source) as n_files, avg(n_chars) as nodes, avg(len(string_split(text, ' '))) as tokens,
         round(avg(n_chars) * log2(greatest(avg(len(string_split(text, ' '))) + 1, 2)) + case when count(distinct source) > 1 then 20.0 else 0.0 end, 4) as score
       from documents group by 1, 2 having count(*) > 1"""
)
def exact_clone_clusters(f: Facts) -> DataFrame:
    docs = f.documents.select(F.col("lang").alias("language"), F.col("text").alias("body"), F.col("source").alias("file_path"), F.col("n_chars").alias("n_nodes"), F.size(F.split("text", " ")).alias("n_tokens"))
    return clones.exact_clusters(docs)


@query(
    """with tok as (select item_id as id, string_split(lower(text), ' ') as t from benchmark union all select doc_id + 1000000, string_split(lower(text), ' ') from documents),
       g as (select distinct id, array_to_string(t[i:i + 4], ' ') as s from (select id, t, unnest(range(1, len(t) - 3)) as i from tok where len(t) >= 5)),
       r as (select s from g group by s having count(*) between 2 and 40)
       select a.id as left, b.id as right, count(*) as shared from g a join g b on a.s = b.s and a.id < b.id where a.s in (select s from r) group by 1, 2 having count(*) >= 4"""
)
def shingle_pairs(f: Facts) -> DataFrame:
    tokens = F.split(F.lower("text"), " ").alias("t")
    texts = f.documents.select((F.col("doc_id") + 1000000).alias("id"), tokens)
    return clones.shared_shingles(clones.shingles(f.benchmark.select(F.col("item_id").alias("id"), tokens).unionByName(texts), "id", "t", hashed=True))


@query(
    """select l as line_text, count(*) as n_places, count(distinct doc_id) as n_texts from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) x
       where trim(l) <> '' group by 1 having count(*) >= 2"""
)
def repeated_lines(f: Facts) -> DataFrame:
    return clones.repeated_lines(scan.lines(f.documents, "doc_id", "text").withColumnRenamed("doc_id", "id"))


@query(
    """select doc_id, n as line, l as line_text from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as n from documents) x
       where regexp_matches(l, 'token = "[0-9a-f]+"')"""
)
def grep_lines(f: Facts) -> DataFrame:
    return dsl.grep(scan.lines(f.documents, "doc_id", "text"), 'token = "[0-9a-f]+"')


@query("select conv_id, turn from conversations where regexp_matches(text, '(?is)^\\s*(select\\b.+\\bfrom\\b)')")
def sql_regions(f: Facts) -> DataFrame:
    return f.conversations.where(dsl.region_kind(F.col("text")) == "sql").select("conv_id", "turn")


@query("select qualified_name as id from symbol where contains(lower(name), 'supp') and contains(lower(name), '003')", "symbol")
def trigram_search(f: Facts) -> DataFrame:
    index = clones.trigrams(f.symbol, "qualified_name", "name")
    return clones.trigram_search(index, "supp").join(clones.trigram_search(index, "003"), "id")


@query("select page_id, string_agg(t, ',' order by t) as tags from (select distinct page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) as t from pages) x group by 1")
def markup_tags(f: Facts) -> DataFrame:
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))))
    return f.pages.select("page_id", F.array_join(tags, ",").alias("tags")).where("tags <> ''")


# -- incremental state --------------------------------------------------------------
@query(
    """with old as (select 'd' || cast(doc_id as string) as p, n_chars as h from documents where doc_id % 7 <> 0),
            new as (select 'd' || cast(doc_id as string) as p, case when doc_id % 5 = 0 then n_chars + 1 else n_chars end as h from documents where doc_id % 11 <> 0 or doc_id % 7 = 0)
       select coalesce(old.p, new.p) as file_path, case when old.p is null then 'new' when new.p is null then 'deleted' when old.h = new.h then 'unchanged' else 'changed' end as status
       from old full join new on old.p = new.p"""
)
def manifest_diff(f: Facts) -> DataFrame:
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path")
    old = f.documents.where("doc_id % 7 <> 0").select(path, F.col("n_chars").alias("content_hash"))
    new = f.documents.where("doc_id % 11 <> 0 or doc_id % 7 = 0").select(path, F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("content_hash"))
    return state.manifest_diff(old, new)


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) x where n = 1")
def overlay_latest(f: Facts) -> DataFrame:
    return relational.latest_by(f.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query(
    """select * from symbol where file_path not in ('f1.py', 'f2.py') union all
       select qualified_name, file_path, name || '_new', kind, line, end_line, parent from symbol where file_path = 'f1.py'""",
    "symbol",
)
def upsert_by_file(f: Facts) -> DataFrame:
    new = f.symbol.where("file_path = 'f1.py'").withColumn("name", F.concat("name", F.lit("_new")))
    return store.without_files(f.symbol, ids(f, "file_path", "f1.py", "f2.py")).unionByName(new)


@query("select * from call where file_path <> 'f3.py'", "call")
def remove_files(f: Facts) -> DataFrame:
    return store.without_files(f.call, ids(f, "file_path", "f3.py"))


@query("select relation, count(*) as n from (select 'symbol' as relation from symbol union all select 'call' from call union all select 'reference' from reference) x group by 1", "symbol call reference")
def relation_counts(f: Facts) -> DataFrame:
    parts = [df.select(F.lit(n).alias("relation")) for n, df in (("symbol", f.symbol), ("call", f.call), ("reference", f.reference))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("relation").agg(F.count("*").alias("n"))


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def hourly_events(f: Facts) -> DataFrame:
    return state.windowed_counts(f.events, "ts", "event_type", "1 hour", "1 day")


# -- value flow and sequences --------------------------------------------------------
@query(
    """, edge as (select event_id as src, next_id as dst from flow_event where next_id is not null),
       clean as (select event_id from flow_event where role <> 'error'),
       reach(source, node) as (select event_id, event_id from flow_event where role = 'signup'
         union select r.source, e.dst from reach r join edge e on e.src = r.node where e.dst in (select event_id from clean))
       select source, node as sink from reach where node in (select event_id from flow_event where role = 'purchase') and source <> node""",
    "flow_event",
)
def flow_rule(f: Facts) -> DataFrame:
    e = f.flow_event
    of = lambda role: e.where(F.col("role") == role).select(F.col("event_id").alias("node"))
    edges = e.where("next_id is not null").select(F.col("event_id").alias("src"), F.col("next_id").alias("dst"))
    return checks.flow_violations(edges, of("signup"), of("purchase"), of("error"))


@query(
    """, b as (select file_path, func_qn, block_id as bb from cfg_block where block_id % 4 = 3),
       a as (select file_path, func_qn, block_id from cfg_block where block_id % 4 = 0),
       z as (select file_path, func_qn, block_id from cfg_block where block_id % 4 = 2),
       walk(file_path, func_qn, b0, node) as (
         select a.file_path, a.func_qn, a.block_id, e.to_block from a join cfg_edge e on e.file_path = a.file_path and e.func_qn = a.func_qn and e.from_block = a.block_id
         union select w.file_path, w.func_qn, w.b0, e.to_block from walk w join cfg_edge e on e.file_path = w.file_path and e.func_qn = w.func_qn and e.from_block = w.node
           where not exists (select 1 from b where b.file_path = w.file_path and b.func_qn = w.func_qn and b.bb = w.node))
       select distinct w.file_path, w.func_qn, b0 * 10 as first_line, node * 10 + 5 as last_line from walk w join z on z.file_path = w.file_path and z.func_qn = w.func_qn and z.block_id = w.node""",
    "cfg_block cfg_edge",
)
def sequence_rule(f: Facts) -> DataFrame:
    step = lambda k, add: f.cfg_block.where(F.col("block_id") % 4 == k).select("file_path", "func_qn", "block_id", (F.col("block_id") * 10 + add).alias("line"))
    return checks.sequences(step(0, 0), step(2, 5), f.cfg_edge, step(3, 1))


# -- search and edit plans --------------------------------------------------------------
@query(
    """, spots as (select distinct file_path, line * 37 as changed from call),
       held as (select a.file_path, a.changed, s.qualified_name, row_number() over (partition by a.file_path, a.changed order by s.line desc, s.end_line, s.qualified_name desc) as n
                from spots a join symbol s on s.file_path = a.file_path and a.changed between s.line and s.end_line)
       select distinct qualified_name from held where n = 1""",
    "call symbol",
)
def changed_symbols(f: Facts) -> DataFrame:
    spans = f.call.select("file_path", (F.col("line") * 37).alias("start"), (F.col("line") * 37 + 1).alias("stop")).distinct()
    return search.changed_symbols(f.symbol, spans)


@query(
    """select file_path, line, col, cast(2 as integer) as length, 'renamed' as replacement from reference where symbol_qn = 's4'
       union select file_path, line, cast(-1 as bigint), cast(2 as integer), 'renamed' from symbol where qualified_name = 's4'""",
    "reference symbol",
)
def rename_plan(f: Facts) -> DataFrame:
    return search.rename_plan(f.symbol, f.reference, "s4", "renamed")


@query(
    """, gone as (select 's1' as qn, 'target' as reason union all select 's2', 'target'
         union all select distinct callee_qn, 'cascade' from call c where caller_qn in ('s1', 's2') and callee_qn not in ('s1', 's2')
           and not exists (select 1 from call o where o.callee_qn = c.callee_qn and o.caller_qn not in ('s1', 's2')))
       select file_path, line, end_line, qualified_name, reason from symbol join gone on qn = qualified_name""",
    "symbol call",
)
def delete_plan(f: Facts) -> DataFrame:
    return search.delete_plan(f.symbol, f.call, ids(f, "qn", "s1", "s2"))


@query("select n_name as source, r_name as target from nation join region on n_regionkey = r_regionkey where n_name = 'NATION_3' or r_name = 'ASIA'")
def mapping_lookup(f: Facts) -> DataFrame:
    pairs = f.nation.join(f.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    return search.mappings_for(pairs.withColumns({"source_project": F.lit("n"), "target_project": F.lit("r")}), "ASIA").select("source", "target").union(
        search.mappings_for(pairs.withColumns({"source_project": F.lit("n"), "target_project": F.lit("r")}), "NATION_3", direction="source").select("source", "target")
    )


@query(
    """select qualified_name, name, kind from symbol where (kind like 'func%' or kind = 'class') and (name like 'test%' or name like '%1') and coalesce(parent, '') = ''""",
    "symbol",
)
def symbol_query(f: Facts) -> DataFrame:
    rows = f.symbol.withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1))
    return search.query_symbols(rows, kinds=["func*", "class"], name=["test*", "*1"], depths=["0"]).select("qualified_name", "name", "kind")

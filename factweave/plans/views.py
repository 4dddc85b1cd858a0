"""Fact views derived from the shared star-schema tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factweave.plans.storage import stored

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "symbol": """
        select 'p' || cast(p_partkey as string) as qualified_name,
               'f' || cast(p_partkey % 50 as string) || '.py' as file_path,
               case when p_partkey % 29 = 0 then '__p' || cast(p_partkey as string) || '__'
                    when p_partkey % 11 = 0 then '_p' || cast(p_partkey as string)
                    when p_partkey % 13 = 0 then 'test_' || lower(p_brand)
                    else replace(lower(p_name), ' ', '_') end as name,
               case p_size % 4 when 0 then 'function' when 1 then 'class' when 2 then 'method' else 'variable' end as kind,
               cast(p_partkey % 1000 * 10 + 1 as bigint) as line,
               cast(p_partkey % 1000 * 10 + 1 + p_size as bigint) as end_line,
               case when p_size % 4 = 2 then 's' || cast(p_partkey % 10 as string) end as parent
        from part
        union all
        select 's' || cast(s_suppkey as string), 'f' || cast(s_suppkey % 50 as string) || '.py', replace(lower(s_name), '#', '_'), 'class',
               cast(1 as bigint), cast(2000 as bigint), cast(null as string)
        from supplier""",
    "call": """
        select distinct * from (
            select 's' || cast(l_suppkey as string) as caller_qn, 'p' || cast(l_partkey as string) as callee_qn,
                   'f' || cast(l_orderkey % 50 as string) || '.py' as file_path, cast(l_linenumber as bigint) as line,
                   cast(l_orderkey % 80 as bigint) as col, 's' || cast(l_suppkey as string) as func_qn, cast(l_orderkey % 7 as bigint) as block_id
            from lineitem where l_quantity >= 49
            union all
            select 'p' || cast(l_partkey as string), 's' || cast(l_partkey % 10 as string), 'f' || cast(l_orderkey % 50 as string) || '.py',
                   cast(l_linenumber as bigint), cast(l_orderkey % 80 as bigint), 'p' || cast(l_partkey as string), cast(l_orderkey % 7 as bigint)
            from lineitem where l_quantity >= 49 and l_returnflag = 'R')""",
    "reference": """
        select distinct callee_qn as symbol_qn, file_path, line, col,
               case when col % 5 = 0 then 'read' when col % 5 = 1 then 'write' when col % 5 = 2 then 'import' else 'call' end as ref_kind, func_qn, block_id
        from call
        union all
        select qualified_name, file_path, line, cast(0 as bigint), 'definition', cast(null as string), cast(null as bigint) from symbol""",
    "ref_by_block": "select distinct file_path, func_qn, block_id, symbol_qn from reference where func_qn is not null",
    "reachable_block": "select distinct file_path, func_qn, block_id from reference where func_qn is not null and block_id <> 3",
    "module_level_ref": "select distinct callee_qn as symbol_qn, file_path, line from call where col % 40 = 7",
    "decorator_on": """
        select 'p' || cast(p_partkey as string) as symbol_qn, case when p_partkey % 2 = 0 then 'App.Route' else 'pytest.fixture' end as decorator,
               'f' || cast(p_partkey % 50 as string) || '.py' as file_path
        from part where p_partkey % 17 = 0""",
    "exported_symbol": "select 'f' || cast(p_partkey % 50 as string) || '.py' as file_path, 'p' || cast(p_partkey as string) as qualified_name from part where p_partkey % 23 = 0",
    "file_namespace": "select distinct file_path, case when length(file_path) % 2 = 0 then 'python' else 'rust' end as namespace from symbol",
    "import_": """
        select distinct 'f' || cast(o_custkey % 50 as string) || '.py' as importing_file, 'pkg.f' || cast(o_orderkey % 50 as string) as imported_module,
               case when o_orderkey % 3 = 0 then '' else 'p' || cast(o_custkey as string) end as imported_name, cast(o_orderkey % 40 as bigint) as line
        from orders""",
    "method_call": """
        select distinct 'f' || cast(l_orderkey % 50 as string) || '.py' as file_path, 's' || cast(l_suppkey as string) as func_qn,
               'v' || cast(l_partkey % 5 as string) as receiver, 'm' || cast(l_linenumber as string) as method,
               cast(l_orderkey % 7 as bigint) as block_id, cast(l_orderkey % 90 as bigint) as line
        from lineitem""",
    "def_use": """
        select distinct 'f' || cast(l_orderkey % 50 as string) || '.py' as file_path, 's' || cast(l_suppkey as string) as func_qn,
               'v' || cast(l_partkey % 5 as string) as var_name, 'write' as kind, cast(l_linenumber % 3 as bigint) as def_block,
               cast(l_orderkey % 7 as bigint) as use_block, cast(l_partkey % 30 as bigint) as def_line, cast(l_orderkey % 90 as bigint) as use_line
        from lineitem""",
    "type_binding": """
        select distinct 'v' || cast(p_partkey % 5 as string) as symbol_qn, 'f' || cast(p_partkey % 50 as string) || '.py' as file_path,
               cast(p_partkey % 30 as bigint) as line, 'inferred' as binding_kind, 'lib.T' || cast(p_size % 6 as string) as type_str
        from part""",
    "cfg_block": """
        select 'c' || cast(conv_id % 20 as string) as file_path, 'conv' || cast(conv_id as string) as func_qn, turn as block_id,
               turn = first_turn as is_entry, turn = last_turn as is_exit
        from (select conv_id, turn, min(turn) over (partition by conv_id) as first_turn, max(turn) over (partition by conv_id) as last_turn
              from (select distinct conv_id, turn from conversations) a) b""",
    "cfg_edge": """
        select distinct 'c' || cast(conv_id % 20 as string) as file_path, 'conv' || cast(conv_id as string) as func_qn, turn as from_block,
               case when (conv_id + turn) % 3 = 1 then turn + 2 else turn + 1 end as to_block, 'fallthrough' as edge_kind
        from conversations""",
    "search_symbol": """
        select file_path, 'pkg.' || replace(file_path, '.py', '') || '.' || name as module_qualified_name, name, qualified_name, kind, line, end_line,
               cast(case when parent is null then 0 else 1 end as bigint) as depth, parent,
               case when kind in ('function', 'method') then '(self, n' || cast(line % 7 as string) || ': dict[str, int], *args)' else '' end as signature,
               case when line % 3 = 0 then 'int' when line % 3 = 1 then 'list[str]' else '' end as returns,
               case when line % 4 = 1 then 'app.route,cached' when line % 4 = 3 then 'property' else '' end as decorators
        from symbol""",
    "trace_flow": """
        select distinct 'v' || cast(l_partkey % 5 as string) as source_var, 'w' || cast(l_suppkey % 5 as string) as sink_var,
               case l_returnflag when 'R' then 'sqli' when 'A' then 'xss' else 'path' end as label, 'f' || cast(l_orderkey % 50 as string) || '.py' as file_path,
               's' || cast(l_suppkey as string) as func_qn, cast(l_linenumber as bigint) as source_line, cast(l_linenumber + l_orderkey % 20 as bigint) as sink_line
        from lineitem""",
    "source_loc": "select file_path, kind as loc_kind, qualified_name as loc_id, line, cast(0 as bigint) as col, end_line, line % 100 as rel_line from symbol",
    "func_summary": """
        select 's' || cast(s_suppkey as string) as func_qn, 'n' || cast(s_nationkey % 3 as string) as param_name, 'f' || cast(s_suppkey % 50 as string) || '.py' as file_path,
               s_suppkey % 2 = 0 as flows_to_return, s_suppkey % 3 = 0 as flows_to_sink, case when s_suppkey % 3 = 0 then 'sqli' else '' end as sink_label
        from supplier""",
    "code_call": """
        select p_partkey as id, 'f' || cast(p_partkey % 50 as string) || '.py' as file_path, p_partkey % 10 as target, p_size as size, p_partkey % 4 as shape
        from part""",
    "order_line": """
        select distinct 'o' || cast(l_orderkey % 200 as string) as func_id, 'f' || cast(l_orderkey % 50 as string) || '.py' as file_path, cast(l_linenumber as bigint) as step,
               'v' || cast((l_orderkey + l_linenumber) % 2 as string) as var,
               case when (l_orderkey % 200 + l_linenumber) % 3 = 0 then 'def' else 'use' end as role
        from lineitem""",
    "flow_event": """
        select 'u' || cast(user_id % 40 as string) as file_path, event_id, event_type as role, user_id,
               lead(event_id) over (partition by user_id order by ts, event_id) as next_id
        from events""",
}
def _needs(name: str) -> list[str]:
    """Views that a view reads, in order of definition."""
    text = VIEWS[name]
    return [v for v in VIEWS if v != name and re.search(rf"\bfrom {v}\b", text)]


def with_views(names: str, body: str) -> str:
    """SQL with the named views (and those they read) as common table expressions."""
    wanted: list[str] = []

    def add(n: str) -> None:
        for m in _needs(n):
            add(m)
        if n not in wanted:
            wanted.append(n)

    for n in names.split():
        add(n)
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in wanted) + "\n" + body


class Facts:
    """Views over the tables of a directory, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.kept = spark, sf_dir, {}

    def keep(self, *names: str) -> Facts:
        """Stores views that a query reads several times, directly or through others; what needs them reads the stored rows."""
        for name in names:
            self.kept[name] = stored(getattr(self, name), name)
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.kept:
            return self.kept[name]
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        inputs = {n: getattr(self, n) for n in [*TABLES, *VIEWS] if n != name and re.search(rf"\bfrom {n}\b", VIEWS[name])}
        text = VIEWS[name]
        for n in inputs:
            text = re.sub(rf"\bfrom {n}\b", f"from {{{n}}}", text)
        return self.spark.sql(text, **inputs)

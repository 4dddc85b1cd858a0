"""Schemas of the fact relations.  Strings and numbers that are absent are null here; `decoded` turns "" and -1 into null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1"
_KINDS = {"s": T.StringType(), "i": T.LongType(), "b": T.BooleanType()}


def _relation(keys: str, values: str = "") -> T.StructType:
    """`name:kind` words; keys can't be null."""
    field = lambda word, null: T.StructField(word.split(":")[0], _KINDS[word.split(":")[1]], null)
    return T.StructType([*(field(w, False) for w in keys.split()), *(field(w, True) for w in values.split())])


#: Columns by relation, key columns first.
RELATIONS: dict[str, T.StructType] = {
    "symbol": _relation("qualified_name:s file_path:s", "name:s kind:s line:i end_line:i parent:s"),
    "search_symbol": _relation(
        "file_path:s module_qualified_name:s", "name:s qualified_name:s kind:s line:i end_line:i depth:i parent:s signature:s returns:s decorators:s"
    ),
    "call": _relation("caller_qn:s callee_qn:s file_path:s line:i col:i", "func_qn:s block_id:i"),
    "reference": _relation("symbol_qn:s file_path:s line:i col:i", "ref_kind:s func_qn:s block_id:i"),
    "trace_flow": _relation("source_var:s sink_var:s label:s file_path:s func_qn:s source_line:i sink_line:i"),
    "type_binding": _relation("symbol_qn:s file_path:s line:i binding_kind:s", "type_str:s"),
    "import": _relation("importing_file:s imported_module:s imported_name:s line:i", "alias:s"),
    "cfg_block": _relation("file_path:s func_qn:s block_id:i", "is_entry:b is_exit:b"),
    "cfg_edge": _relation("file_path:s func_qn:s from_block:i to_block:i edge_kind:s from_line:i to_line:i"),
    "flow_event": _relation(
        "file_path:s event_id:i",
        "func_id:s func_name:s func_start:i role:s var:s access_path:s block:i start_byte:i end_byte:i start_line:i start_col:i "
        "end_line:i end_col:i ordinal:i call_id:i arg_index:i arg_name:s text:s",
    ),
    "flow_edge": _relation("file_path:s from_event:i to_event:i edge_kind:s"),
    "def_use": _relation("file_path:s func_qn:s var_name:s kind:s def_block:i use_block:i def_line:i use_line:i", "def_col:i use_col:i"),
    "method_call": _relation("file_path:s func_qn:s receiver:s method:s block_id:i line:i"),
    "decorator_on": _relation("symbol_qn:s decorator:s file_path:s"),
    "source_loc": _relation("file_path:s loc_kind:s loc_id:s", "line:i col:i end_line:i rel_line:i"),
    "func_summary": _relation("func_qn:s param_name:s file_path:s", "flows_to_return:b flows_to_sink:b sink_label:s"),
    "entry_point_decorator": _relation("decorator:s"),
    "entry_point_name": _relation("name:s"),
    "entry_point_prefix": _relation("prefix:s"),
    "exported_symbol": _relation("file_path:s qualified_name:s"),
    "file_revision": _relation("file_path:s", "content_hash:s language:s module_name:s origin:s version:i"),
    "file_namespace": _relation("file_path:s", "namespace:s"),
    "ref_by_block": _relation("file_path:s func_qn:s block_id:i symbol_qn:s"),
    "noncall_private_member_ref": _relation("file_path:s func_qn:s block_id:i member_name:s"),
    "reachable_block": _relation("file_path:s func_qn:s block_id:i"),
    "module_level_ref": _relation("symbol_qn:s file_path:s line:i"),
    "facts_meta": _relation("key:s", "value:s"),
}
#: Copies of a relation in another order, and the column that leads it.
ALIASES = {"call_by_callee": "call", "call_by_file": "call"}
LEADING = {"call_by_callee": "callee_qn", "call_by_file": "file_path"}


def keys(relation: str) -> list[str]:
    return [f.name for f in RELATIONS[ALIASES.get(relation, relation)] if not f.nullable]


def decoded(df: DataFrame) -> DataFrame:
    """"" and -1 in value columns become null."""
    out = {}
    for f in df.schema:
        if f.nullable and isinstance(f.dataType, T.StringType):
            out[f.name] = F.nullif(F.col(f.name), F.lit(""))
        elif f.nullable and isinstance(f.dataType, (T.LongType, T.IntegerType)):
            out[f.name] = F.nullif(F.col(f.name), F.lit(-1).cast(f.dataType))
    return df.withColumns(out) if out else df

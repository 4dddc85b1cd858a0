"""Graph algorithms per function or call component: dominators, reaching definitions, balanced value flow."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import recursive


def dominators(blocks: DataFrame, edges: DataFrame, post: bool = False) -> DataFrame:
    """file_path, func_qn, block_id, dominator: blocks on every path from the entry (post: to the exit).

    A block without a way in from the entry is only its own dominator.  One task per function.
    """
    keys = ["file_path", "func_qn"]
    a, b = ("to_block", "from_block") if post else ("from_block", "to_block")
    ways = edges.select(*keys, F.col(a).alias("src"), F.col(b).alias("dst"))
    nodes = blocks.select(*keys, "block_id", F.col("is_exit" if post else "is_entry").alias("start"))

    def solve(nodes: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        out = dominator_sets(nodes["block_id"].tolist(), set(nodes["block_id"][nodes["start"]]), list(zip(ways["src"], ways["dst"], strict=True)))
        head = nodes[keys].iloc[0].tolist() if len(nodes) else ["", ""]
        return pd.DataFrame([(*head, n, d) for n, ds in out.items() for d in ds], columns=[*keys, "block_id", "dominator"])

    return nodes.groupBy(*keys).cogroup(ways.groupBy(*keys)).applyInPandas(solve, "file_path string, func_qn string, block_id long, dominator long")


def dominator_sets(nodes: list[int], starts: set[int], ways: list[tuple[int, int]]) -> dict[int, set[int]]:
    """Greatest fixed point over the nodes that a start reaches."""
    after: dict[int, list[int]] = {}
    before: dict[int, list[int]] = {}
    for a, b in ways:
        after.setdefault(a, []).append(b)
    seen, todo = set(starts), deque(starts)
    while todo:
        for b in after.get(todo.popleft(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    for a, b in ways:
        if a in seen:
            before.setdefault(b, []).append(a)
    out = {n: {n} if n in starts or n not in seen else set(seen) for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            if n in starts or n not in seen:
                continue
            new = {n} | set.intersection(*(out[p] for p in before[n] if p in out))
            if new != out[n]:
                out[n], changed = new, True
    return out


def reaching(events: DataFrame, edges: DataFrame) -> DataFrame:
    """from_event, to_event of definitions and the uses that they reach without another definition of the variable between.

    events: file_path, func_id, event_id, role (def or use), var; edges: file_path, func_id, from_event, to_event.  One task
    per function.
    """
    keys = ["file_path", "func_id"]

    def solve(events: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        role = {e: (r, v) for e, r, v in events[["event_id", "role", "var"]].itertuples(index=False)}
        after: dict[int, list[int]] = {}
        for a, b in zip(edges["from_event"], edges["to_event"], strict=True):
            after.setdefault(a, []).append(b)
        rows = []
        for d, (r, v) in role.items():
            if r != "def":
                continue
            seen, todo = set(), deque(after.get(d, ()))
            while todo:
                e = todo.popleft()
                if e in seen:
                    continue
                seen.add(e)
                kind, var = role.get(e, ("", None))
                if kind == "use" and var == v:
                    rows.append((d, e))
                if not (kind == "def" and var == v):
                    todo.extend(after.get(e, ()))
        head = events[keys].iloc[0].tolist() if len(events) else ["", ""]
        return pd.DataFrame([(*head, a, b) for a, b in rows], columns=[*keys, "from_event", "to_event"])

    return events.groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(solve, "file_path string, func_id string, from_event long, to_event long")


def balanced_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int | None = None) -> DataFrame:
    """component, source, sink and witness (comma-joined nodes) of the shortest paths on which calls and returns match.

    edges: component, src, dst, kind (value, call_arg, call_return), call_id.  Entering a call pushes its id; a return must match
    the last one, and with nothing pushed may go anywhere; entering a call that is already open keeps the stack, so the
    search ends; at most `depth` calls are open if it is given.  Components are connected by calls, and each is one task.
    """

    def search(edges: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        after: dict[int, list[tuple]] = {}
        for a, b, kind, call in edges[["src", "dst", "kind", "call_id"]].itertuples(index=False, name=None):
            after.setdefault(a, []).append((b, kind, call))
        goals = set(ends["node"][ends["side"] == "sink"])
        rows = []
        for source in ends["node"][ends["side"] == "source"]:
            start = (source, ())
            back: dict[tuple, tuple | None] = {start: None}
            todo, found = deque([start]), set()
            while todo:
                state = todo.popleft()
                node, stack = state
                if node in goals and node != source and node not in found:
                    found.add(node)
                    path, s = [], state
                    while s is not None:
                        path.append(str(s[0]))
                        s = back[s]
                    rows.append((source, node, ",".join(path[::-1])))
                for b, kind, call in after.get(node, ()):
                    to = step(stack, kind, call, depth)
                    if to is not None and (b, to) not in back:
                        back[b, to] = state
                        todo.append((b, to))
        name = edges["component"].iloc[0] if len(edges) else ends["component"].iloc[0]
        return pd.DataFrame([(name, *r) for r in rows], columns=["component", "source", "sink", "witness"])

    ends = sources.select("component", "node", F.lit("source").alias("side")).union(sinks.select("component", "node", F.lit("sink")))
    return edges.groupBy("component").cogroup(ends.groupBy("component")).applyInPandas(search, "component long, source long, sink long, witness string")


def step(stack: tuple, kind: str, call: int | None, depth: int | None) -> tuple | None:
    """Stack after an edge, or None if it can't be taken."""
    if kind == "call_arg":
        if call in stack:
            return stack
        return (*stack, call) if depth is None or len(stack) < depth else None
    if kind == "call_return":
        if not stack:
            return stack
        return stack[:-1] if stack[-1] == call else None
    return stack


def call_components(edges: DataFrame) -> DataFrame:
    """edges (src, dst, kind, call_id) with the component they belong to."""
    named = recursive.components(edges.select("src", "dst"))
    return edges.join(named.withColumnRenamed("node", "src"), "src").select("component", "src", "dst", "kind", "call_id")


def summaries(edges: DataFrame, params: DataFrame, returns: DataFrame, sinks: DataFrame) -> DataFrame:
    """func_qn, param_name, flows_to_return, flows_to_sink of every parameter.

    edges: src, dst inside functions, and func_qn if known; params: func_qn, param_name, node; returns: func_qn, node; sinks: node,
    and func_qn if known.  Returns and sinks are followed back, so no pairs of parameters and nodes are made.  Each function is
    in one task; without func_qn it has the components of its parameters.
    """
    edges = edges.where("src is not null and dst is not null")
    params = params.select("func_qn", "param_name", "node").where("node is not null")
    if "func_qn" not in edges.columns:
        named = recursive.components(edges.select("src", "dst"))
        owners = params.join(named, "node").select("func_qn", "component").distinct()
        edges = edges.join(named.withColumnRenamed("node", "src"), "src").join(owners, "component")
    if "func_qn" not in sinks.columns:
        own = params.select("func_qn", "node").union(edges.select("func_qn", "dst")).distinct()
        sinks = own.join(sinks.select("node").distinct(), "node")
    name, node = params.schema["param_name"].dataType, params.schema["node"].dataType
    no_name, no_node = F.lit(None).cast(name).alias("param_name"), F.lit(None).cast(node).alias("dst")
    marks = [df.select("func_qn", F.lit(what).alias("what"), no_name, "node", no_node).where("node is not null") for what, df in (("return", returns), ("sink", sinks))]
    every = edges.select("func_qn", F.lit("edge").alias("what"), no_name, F.col("src").alias("node"), "dst").union(params.select("func_qn", F.lit("param"), "param_name", "node", no_node))
    every = every.union(marks[0]).union(marks[1]).repartition("func_qn").sortWithinPartitions("func_qn")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for functions in whole_groups(batches, "func_qn"):
            yield from flows(functions).to_batches()

    kinds = params.select("func_qn", "param_name", F.lit(True).alias("flows_to_return"), F.lit(True).alias("flows_to_sink")).schema
    return every.mapInArrow(solve, kinds)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 200_000) -> Iterator[pa.Table]:
    """Tables of batches that are sorted by a key, of `least` rows or more but for the last, none of which ends inside a key's rows."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        cut = keys.index(keys[-1])
        if rows + cut >= least and (cut or keys[0] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows, last = rows + batch.num_rows, keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def flows(functions: pa.Table) -> pa.Table:
    """func_qn, param_name, flows_to_return, flows_to_sink of whole functions: func_qn, what (edge, param, return or sink), param_name, node, dst."""
    coded = lambda x: np.asarray(x.combine_chunks().dictionary_encode("encode").indices)
    marked = lambda what: pc.equal(functions["what"], what).to_numpy()
    func, edge, is_param = coded(functions["func_qn"]), marked("edge"), marked("param")
    at = coded(pa.chunked_array([*functions["node"].chunks, *functions["dst"].filter(pa.array(edge)).chunks]))
    if func.any():  # the same node may be in several functions
        at = np.unique(np.concatenate([func, func[edge]]) * np.int64(len(at)) + at, return_inverse=True)[1]
    node, dst = at[: len(func)], at[len(func) :]
    src = node[edge][np.argsort(dst, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(dst, minlength=at.max(initial=-1) + 1))])
    out = functions.select(["func_qn", "param_name"]).filter(pa.array(is_param))
    for column, mark in (("flows_to_return", "return"), ("flows_to_sink", "sink")):
        out = out.append_column(column, pa.array(leading_to(node[marked(mark)], src, first)[node[is_param]]))
    sums = out.group_by(["func_qn", "param_name"]).aggregate([("flows_to_return", "any"), ("flows_to_sink", "any")])
    return pa.table([sums[c] for c in ("func_qn", "param_name", "flows_to_return_any", "flows_to_sink_any")], names=out.column_names)


def leading_to(goals: np.ndarray, src: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a goal can be reached from each node, itself included; the edges into node k begin at src[first[k] : first[k + 1]]."""
    seen, frontier = np.zeros(len(first) - 1, dtype=bool), np.unique(goals)
    while len(frontier):
        seen[frontier] = True
        n = first[frontier + 1] - first[frontier]
        before = src[np.repeat(first[frontier] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        frontier = np.unique(before[~seen[before]])
    return seen


def cross_file_calls(call_events: DataFrame, call: DataFrame, params: DataFrame) -> DataFrame:
    """Argument events joined to the parameter events of the called function, by name if given, else by index.

    call_events: file_path, line, arg_event, arg_index, arg_name; call: file_path, line, callee_qn; params: func_qn, param_event,
    param_index, param_name.  Calls with several callees at one place aren't linked.
    """
    one = call.groupBy("file_path", "line").agg(F.countDistinct("callee_qn").alias("n"), F.first("callee_qn").alias("func_qn")).where("n = 1")
    at = call_events.join(one, ["file_path", "line"])
    named = at.where("arg_name is not null").join(params, (at.func_qn == params.func_qn) & (at.arg_name == params.param_name))
    placed = at.where("arg_name is null").join(params, (at.func_qn == params.func_qn) & (at.arg_index == params.param_index))
    return named.select("arg_event", "param_event").union(placed.select("arg_event", "param_event")).distinct()

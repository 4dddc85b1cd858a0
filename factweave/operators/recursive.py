"""Reachability, layers and components by semi-naive rounds.

Every round joins only the frontier to the edges, drops what was seen, and stores the new rows; plans stay flat and a lost
executor costs one round.  Extra key columns travel with the frontier, so many closures run in one loop.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.plans.storage import Scratch, discard, stored, together


#: A closure over at most this many edges (times the number of starts that are told apart) runs in one task.
SMALL_WORK, SMALL_EDGES = 50_000_000, 1_000_000


def reachable(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = (), carry: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """keys, carry, node and level (least number of steps) of everything reached from seeds, seeds included.

    edges: keys, src, dst; seeds: keys, carry, node.  Carried columns tell starts apart; edges don't have them.  `most` bounds
    the number of steps.  Both inputs are counted first: small ones are searched in one task, others in rounds.
    """
    own, kept = [*keys, *carry], Scratch()
    edges = kept.packed(edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    seeds = kept.packed(seeds.select(*own, "node").where("node is not null").distinct(), "seeds")
    n_edges, n_seeds = edges._factweave_rows, seeds._factweave_rows
    starts = min(n_seeds, seeds.select(*carry).distinct().count()) if carry else 1
    if n_edges <= SMALL_EDGES and n_edges * starts <= SMALL_WORK and n_seeds <= SMALL_EDGES:
        out = stored(_searched(edges, seeds, list(keys), list(carry), most), "reach")
        kept.clear()
        return out
    seen = [seeds.withColumn("level", F.lit(0))]
    while most is None or len(seen) <= most:
        step = seen[-1].select(*own, F.col("node").alias("src")).join(edges, [*keys, "src"]).select(*own, F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, seen).select(*own, "node")
        new = kept.packed(step.join(known, [*own, "node"], "left_anti").withColumn("level", F.lit(len(seen))), "reach")
        if not new._factweave_rows:
            break
        seen.append(new)
    kept.drop(edges)
    return reduce(DataFrame.unionByName, seen)


def _searched(edges: DataFrame, seeds: DataFrame, keys: list[str], carry: list[str], most: int | None) -> DataFrame:
    """The same by breadth-first search over an adjacency table in one task; inputs are known to be small."""
    nk, own = len(keys), [*keys, *carry]

    def search(ways: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        after: dict[tuple, list] = {}
        for row in ways[[*keys, "src", "dst"]].itertuples(index=False, name=None):
            after.setdefault(row[: nk + 1], []).append(row[nk + 1])
        level: dict[tuple, int] = {row: 0 for row in starts[[*own, "node"]].itertuples(index=False, name=None)}
        frontier, depth = list(level), 0
        while frontier and (most is None or depth < most):
            depth, new = depth + 1, []
            for state in frontier:
                for node in after.get((*state[:nk], state[-1]), ()):
                    to = (*state[:-1], node)
                    if to not in level:
                        level[to] = depth
                        new.append(to)
            frontier = new
        return pd.DataFrame([(*state, n) for state, n in level.items()], columns=[*own, "node", "level"])

    one = F.lit(1).alias("_one")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeds.select(*own, "node").schema)
    ways, starts = edges.select("*", one).groupBy("_one"), seeds.select("*", one).groupBy("_one")
    return ways.cogroup(starts).applyInPandas(search, f"{kind}, level int")


def _pairs(call: DataFrame, src: str, dst: str) -> DataFrame:
    return call.select(F.col(src).alias("src"), F.col(dst).alias("dst"))


def transitive_callers(call: DataFrame, symbol: str, most: int | None = None) -> DataFrame:
    """Every function from which the symbol can be reached; not the symbol itself."""
    seed = call.sparkSession.createDataFrame([(symbol,)], "node string")
    return reachable(_pairs(call, "callee_qn", "caller_qn"), seed, most=most).where(F.col("node") != symbol).select(F.col("node").alias("qn"))


def transitive_callees(call: DataFrame, symbol: str, most: int | None = None) -> DataFrame:
    """Everything the symbol can reach by calls; not the symbol itself."""
    seed = call.sparkSession.createDataFrame([(symbol,)], "node string")
    return reachable(_pairs(call, "caller_qn", "callee_qn"), seed, most=most).where(F.col("node") != symbol).select(F.col("node").alias("qn"))


def unreachable_blocks(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks that no path from an entry block of their function reaches; exit blocks aren't reported."""
    keys = ("file_path", "func_qn")
    seeds = blocks.where("is_entry").select(*keys, F.col("block_id").alias("node"))
    ways = edges.select(*keys, F.col("from_block").alias("src"), F.col("to_block").alias("dst"))
    live = reachable(ways, seeds, keys=keys).select(*keys, F.col("node").alias("block_id"))
    return blocks.where("not is_exit").join(live, [*keys, "block_id"], "left_anti").select(*keys, "block_id")


def impact_edges(call: DataFrame, changed: DataFrame, max_depth: int = 10) -> DataFrame:
    """caller_qn, callee_qn of calls into the changed symbols (column qn) or into layers below max_depth - 1.

    Layer 0 is the direct callers; callers that are changed themselves aren't reported.
    """
    ways = _pairs(call, "callee_qn", "caller_qn").distinct()
    if max_depth <= 0:
        return ways.where("false").select(F.col("dst").alias("caller_qn"), F.col("src").alias("callee_qn"))
    direct = ways.join(changed.select(F.col("qn").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
    layers = reachable(ways, direct, most=max(0, max_depth - 1))
    targets = changed.select(F.col("qn").alias("src")).union(layers.where(F.col("level") <= max_depth - 2).select("node")).distinct()
    out = ways.join(targets, "src", "left_semi").select(F.col("dst").alias("caller_qn"), F.col("src").alias("callee_qn"))
    return out.join(changed.select(F.col("qn").alias("caller_qn")), "caller_qn", "left_anti").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of its connected component) of an undirected edge list src, dst.

    Alternating large-star and small-star rounds, at most about the square of the logarithm of the node count.
    """
    kept = Scratch()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now = kept.packed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = kept.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = kept.packed(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = kept.packed(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = together(large.join(low, "a"), large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a <> b").distinct()
        small = kept.packed(small, "edges")
        sums = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        kept.drop(now, least, large, low)
        now = small
        if sums == mark:
            break
        mark = sums
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def entry_points(symbol: DataFrame, decorator_on: DataFrame, exported: DataFrame, decorators: list[str] = (), names: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """qn of symbols that count as used: dunder names, given names and prefixes, exports, decorated ones (case ignored)."""
    name = F.col("name")
    keep = (name.startswith("__") & name.endswith("__")) | name.isin(list(names)) if names else name.startswith("__") & name.endswith("__")
    for p in prefixes:
        keep = keep | name.startswith(p)
    parts = [symbol.where(keep).select(F.col("qualified_name").alias("qn")), exported.select(F.col("qualified_name").alias("qn"))]
    if decorators:
        parts.append(decorator_on.where(F.lower("decorator").isin([d.lower() for d in decorators])).select(F.col("symbol_qn").alias("qn")))
    return reduce(DataFrame.unionByName, parts).distinct()


def dead_code(symbol: DataFrame, ref_by_block: DataFrame, reachable_block: DataFrame, module_refs: DataFrame, entries: DataFrame) -> DataFrame:
    """qn and causes (comma-joined roots, empty for a root) of unused symbols, in strata.

    An edge is a reference from a live block of one function to another symbol.  Roots are top-level symbols that are no
    entry points and that nothing refers to.  What only roots can reach is unused too, with the roots that reach it; an
    isolated cycle that no root reaches isn't reported.
    """
    kept = Scratch()
    live = ref_by_block.join(reachable_block, ["file_path", "func_qn", "block_id"], "left_semi")
    edges = kept.packed(live.where("func_qn <> symbol_qn").select(F.col("func_qn").alias("src"), F.col("symbol_qn").alias("dst")).distinct(), "refs")
    outer = kept.packed(module_refs.select(F.col("symbol_qn").alias("qn")).distinct(), "outer")
    eligible = kept.packed(symbol.where("parent is null").select(F.col("qualified_name").alias("qn")).distinct().join(entries, "qn", "left_anti"), "eligible")
    used = edges.select(F.col("dst").alias("qn")).union(outer)
    roots = stored(eligible.join(together(used, edges, outer), "qn", "left_anti"), "roots")
    inner = together(edges.join(eligible.select(F.col("qn").alias("dst")), "dst", "left_semi"), edges, eligible).select("src", "dst")
    reached = reachable(inner, roots.select(F.col("qn").alias("node")))
    candidates = kept.packed(reached.select(F.col("node").alias("qn")), "candidates")
    discard(reached)
    # Kept: referred to from outside, or from something that is no candidate; and all that those reach among candidates.
    from_others = together(edges.join(candidates.select(F.col("qn").alias("src")), "src", "left_anti"), edges, candidates).select(F.col("dst").alias("qn"))
    kept_seeds = together(from_others.union(outer), edges, outer).join(candidates, "qn", "left_semi").select(F.col("qn").alias("node"))
    among = together(inner.join(candidates.select(F.col("qn").alias("dst")), "dst", "left_semi"), edges, eligible, candidates).select("src", "dst")
    alive = reachable(among, kept_seeds)
    unused = kept.packed(candidates.join(alive.select(F.col("node").alias("qn")), "qn", "left_anti"), "unused")
    discard(alive)
    within = together(among.join(unused.select(F.col("qn").alias("dst")), "dst", "left_semi"), edges, eligible, candidates, unused).select("src", "dst")
    starts = roots.select(F.col("qn").alias("root"), F.col("qn").alias("node"))
    caused = reachable(within, starts, carry=("root",))
    named = caused.select("root", F.col("node").alias("qn")).join(unused, "qn", "left_semi").join(roots, "qn", "left_anti")
    causes = stored(named.groupBy("qn").agg(F.array_join(F.sort_array(F.collect_set("root")), ",").alias("causes")), "causes")
    discard(caused)
    kept.clear()
    return roots.select("qn", F.lit("").alias("causes")).unionByName(causes)

"""Queries over whole tables on the smallest tables, against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

from factweave.plans.queries import QUERIES
from factweave.plans.views import Facts

SF = "/root/testdata/sf0.001"


def test_call_components(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    calls = Facts(spark, SF).call.select("caller_qn", "callee_qn").collect()
    for a, b in calls:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in QUERIES["call_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in root}
    assert set(got) == {x for row in calls for x in row}


def test_shingle_pairs(spark):
    held, lengths = defaultdict(set), {}
    facts = Facts(spark, SF)
    for first, rows in ((1_000_000, facts.documents.select("doc_id", "text").collect()), (0, facts.benchmark.select("item_id", "text").collect())):
        for k, text in rows:
            tokens = (text or "").lower().split(" ")
            lengths[first + k] = len(tokens)
            for i in range(len(tokens) - 4):
                held[tuple(tokens[i : i + 5])].add(first + k)
    shared = Counter(pair for ids in held.values() if len(ids) <= 40 for pair in combinations(sorted(ids), 2))
    got = {(r.left, r.right): r.shared for r in QUERIES["shingle_pairs"](spark, SF).collect()}
    assert got == {pair: n for pair, n in shared.items() if n >= 4}
    assert any(max(lengths[a], lengths[b]) > 200 for a, b in got)


def test_interval_overlap(spark):
    facts = Facts(spark, SF)
    spans = {(r.file_path, r.line * 41, r.line * 41 + 9) for r in facts.call.select("file_path", "line").collect()}
    wanted = []
    for path, line, end in facts.symbol.select("file_path", "line", "end_line").collect():
        wanted += [(path, line, end + 1, a, b) for p, a, b in spans if p == path and line < b and a < end + 1]
    assert sorted(tuple(r) for r in QUERIES["interval_overlap"](spark, SF).collect()) == sorted(wanted)
    assert any(stop == 2001 for _, _, stop, _, _ in wanted)


def test_receivers_and_definitions_of_all_rows(spark):
    facts = Facts(spark, SF)
    uses, calls, types = set(), set(), defaultdict(set)
    for order, supplier, part, number in facts.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber").collect():
        place = (f"f{order % 50}.py", f"s{supplier}", f"v{part % 5}")
        uses.add((*place, "write", number % 3, order % 7, part % 30, order % 90))
        calls.add((*place, f"m{number}", order % 7))
    for path, name, line, kind in facts.type_binding.select("file_path", "symbol_qn", "line", "type_str").collect():
        types[path, name, line].add(kind)
    at, defs, used = defaultdict(set), defaultdict(set), defaultdict(set)
    for *place, _, _, block, line, use in uses:
        at[(*place, block)].add(line)
        defs[tuple(place)].add(line)
        used[tuple(place)].add(use)
    of = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())
    assert of("def_uses") == sorted(r for r in uses if r[1] == "s5" and r[2] == "v2")
    assert of("def_use_pairs") == sorted((*p, a, b) for p in defs for a in defs[p] for b in used[p])
    assert of("receiver_type_join") == sorted({(p, f, v, m, t) for p, f, v, m, b in calls for line in at[p, f, v, b] for t in types[p, v, line]})

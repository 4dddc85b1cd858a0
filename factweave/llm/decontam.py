"""Benchmark decontamination by greedy string tiling.

Tokens are lower-case runs of letters, digits and underscores.  Runs of `min_match` tokens that a document shares with
an item are the seeds; a hash join of all runs of a batch with the item runs finds them.  For each document and item with enough
seeds, running Karp-Rabin finds the longest matches and marks them, longest first, until no unmarked match of min_match
tokens is left.  Tiles don't overlap on either side, and may lie in any order, so reordered passages count.  A document is
contaminated by an item if its tiles cover at least `coverage` of the item's tokens.

The items are a broadcast in blocks of a bounded size; further blocks take further passes over the documents.

Defined results: null and empty texts share nothing; items of fewer than min_match tokens never match; rows that repeat
give repeated results, items that repeat (id and text) count once; ids may be null; of equally long matches the first in the item and then
in the text is marked; an empty table on either side gives no rows; other columns of either table don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from factweave.llm.common import map_batches, texts_of
from factweave.llm.shingles import mix

TOKEN = re.compile(r"\w+")
#: Characters of items that one broadcast block holds on average, and the most items in a block.
BLOCK_CHARS, BLOCK_ITEMS = 4_000_000, 200_000


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def run_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` token ids."""
    total = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        total = mix(total + ids[k : len(ids) - size + 1 + k].astype(np.uint64) + np.uint64(k + 1))
    return total


def tile(pattern: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in pattern, start in text, length) of the longest matches, none overlapping another.

    Negative text tokens match nothing.  The length of the longest unmarked match is found by bisection, as each part of
    a match is one: Karp-Rabin hashes of all unmarked runs of a length tell whether pattern and text share one.
    Matches of that length are marked from left to right.  So a tiling takes linear time for each length that it
    marks, whatever repeats in pattern or text.
    """
    p, t = np.array(pattern, np.int64), np.array(text, np.int64)
    free_p, free_t = np.ones(len(p), bool), t >= 0
    sums_p, sums_t = _rolling(p), _rolling(t)
    tiles: list[tuple[int, int, int]] = []
    most = len(p)
    while True:
        low, high, best = min_match, most, None
        while low <= high:  # the largest length that both sides share
            size = (low + high) // 2
            at = _shared(sums_p, sums_t, free_p, free_t, size)
            if at is not None:
                low, best = size + 1, (size, *at)
            else:
                high = size - 1
        if best is None:
            return tiles
        size, starts_p, hash_p, starts_t, hash_t = best
        # Text places of each hash, in order; those before `next_` are marked.
        order = np.argsort(hash_t, kind="stable")
        keys, first = np.unique(hash_t[order], return_index=True)
        ends = np.append(first[1:], len(order))
        next_ = first.copy()
        done = -1
        for i, h in zip(starts_p.tolist(), hash_p, strict=True):
            if i <= done:
                continue
            k = int(np.searchsorted(keys, h))
            if k == len(keys) or keys[k] != h:
                continue
            at = next_[k]
            while at < ends[k]:
                j = int(starts_t[order[at]])
                if free_t[j] and free_t[j + size - 1]:
                    break
                at += 1
            next_[k] = at
            if at < ends[k] and np.array_equal(p[i : i + size], t[j : j + size]):
                free_p[i : i + size] = free_t[j : j + size] = False
                tiles.append((i, j, size))
                done = i + size - 1
        most = size if tiles and tiles[-1][2] == size and size > min_match else size - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)))


def _rolling(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash, and the powers that shift a difference of two to the front."""
    spread = mix(seq.astype(np.uint64) + np.uint64(7))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * _powers(_BASE, len(seq))[:-1], dtype=np.uint64))), _powers(_BACK, len(seq))


def _runs(sums: tuple[np.ndarray, np.ndarray], free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of `size` free tokens."""
    count = np.concatenate(([0], np.cumsum(free)))
    at = np.flatnonzero(count[size:] - count[:-size] == size) if len(free) >= size else np.zeros(0, np.int64)
    return at, (sums[0][at + size] - sums[0][at]) * sums[1][at]


def _shared(sums_p, sums_t, free_p: np.ndarray, free_t: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Starts and hashes of the unmarked runs of a length that stand on both sides; None if there are none."""
    at_p, hash_p = _runs(sums_p, free_p, size)
    if not len(at_p):
        return None
    at_t, hash_t = _runs(sums_t, free_t, size)
    on_p, on_t = np.isin(hash_p, hash_t), np.isin(hash_t, hash_p)
    return (at_p[on_p], hash_p[on_p], at_t[on_t], hash_t[on_t]) if on_p.any() else None


class Items:
    """A block of items, its vocabulary and the positions of its seed runs."""

    def __init__(self, rows: list[tuple[int, str | None]], min_match: int):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.ids = [i for i, _ in rows]
        self.tokens = [[number(w, len(self.vocabulary)) for w in tokens(text or "")] for _, text in rows]
        seeds = [run_hashes(np.array(t, np.int64), min_match) for t in self.tokens]
        flat = np.concatenate([np.zeros(0, np.uint64), *seeds])
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.item = np.repeat(np.arange(len(rows)), [len(s) for s in seeds])[order]
        #: Where an item's tokens begin among those of all items, and where each seed stands there.
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens])))
        self.place = np.concatenate([np.zeros(0, np.int64), *(self.begin[k] + np.arange(len(s)) for k, s in enumerate(seeds))])[order]
        self.min_match = min_match

    def matches(self, docs: list[list[str]], coverage: float) -> list[tuple[int, int, int, int, int]]:
        """(document, item, covered tokens, item tokens, tiles) over the coverage."""
        out: list[tuple[int, int, int, int, int]] = []
        m, get = self.min_match, self.vocabulary.get
        if not len(self.seeds):
            return out
        for doc, words in enumerate(docs):
            ids = np.array([get(w, -1) for w in words], np.int64)
            if len(ids) < m:
                continue
            missing = np.concatenate(([0], np.cumsum(ids < 0)))
            at = np.flatnonzero(missing[m:] == missing[:-m])
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for k in range(m):
                h = mix(h + ids[at + k].astype(np.uint64) + np.uint64(k + 1))
            lo, hi = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
            hit = hi > lo
            if hit.any():
                out += [(doc, *x) for x in self._tiled(ids, at[hit], lo[hit], hi[hit], coverage)]
        return out

    def _tiled(self, ids: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """Items of one document whose tiles cover enough; at: places of shared runs, lo and hi: their seeds.

        Each distinct run is looked up once, so a document lists every seed of the block at most once, however often
        its runs repeat and however many items share them.
        """
        m = self.min_match
        first, which = np.unique(lo, return_index=True)
        n = hi[which] - first
        seeds = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # No tile lies outside a seed: items whose seeds cover too little are out.
        places = np.unique((self.place[seeds][:, None] + np.arange(m)).ravel())
        held = np.searchsorted(self.begin, places, "right") - 1
        items, counts = np.unique(held, return_counts=True)
        for item in items[counts >= coverage * (self.begin[items + 1] - self.begin[items])].tolist():
            pattern = self.tokens[item]
            own = np.unique(seeds[self.item[seeds] == item])
            spots = at[np.isin(lo, first[np.searchsorted(first, own, "right") - 1])]
            text: list[int] = []
            last = -1
            for p in spots.tolist():  # the stretches that hold seeds, kept apart
                if p > last:
                    text.append(-1)
                    last = p
                text += ids[last : p + m].tolist()
                last = p + m
            tiles = tile(pattern, text, m)
            covered = sum(k for _, _, k in tiles)
            if covered >= coverage * len(pattern):
                yield self.ids[item], covered, len(pattern), len(tiles)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """id, item_id, covered, item_tokens, n_tiles and share, for each document and item whose tiles cover enough of it."""
    kind = benchmark.select("item_id").schema[0].dataType
    return reduce(DataFrame.unionByName, [_against(docs, block, kind, id_col, text_col, coverage) for block in item_blocks(benchmark, min_match)])


def item_blocks(benchmark: DataFrame, min_match: int) -> Iterator[Items]:
    """The items in blocks of bounded size, by hash."""
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-(size.chars or 0) // BLOCK_CHARS), -(-2 * size.n // BLOCK_ITEMS))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield Items([(r.item_id, r.text) for r in block.collect()], min_match)


def _against(docs: DataFrame, items: Items, item_kind: DataType, id_col: str, text_col: str, coverage: float) -> DataFrame:
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(items)
    item_type = to_arrow_type(item_kind)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = shared.value.matches([tokens(t) for t in texts_of(batch.column(1))], coverage)
        if not found:
            return None
        doc, item, covered, length, tiles = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array(item, item_type), *(pa.array(x, pa.int64()) for x in (covered, length, tiles)), pa.array([c / n for c, n in zip(covered, length, strict=True)])],
            names=[id_col, "item_id", "covered", "item_tokens", "n_tiles", "share"],
        )

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, item_id {item_kind.simpleString()}, covered long, item_tokens long, n_tiles long, share double")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """docs without the rows that an item contaminates; all columns stay, and nothing is shuffled."""
    place = docs.columns.index(text_col)
    for items in item_blocks(benchmark, min_match):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = shared.value.matches([tokens(t) for t in texts_of(batch.column(place))], coverage)
            clean = np.ones(batch.num_rows, bool)
            clean[[f[0] for f in found]] = False
            return batch.filter(pa.array(clean))

        docs = map_batches(docs, run, docs.schema)
    return docs

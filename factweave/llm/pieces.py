"""Exact merge-type (BPE) SentencePiece encoding by backtracking, and decoding.

A text is the only possible result of merging characters by priority iff every adjacent pair of its pieces is what
re-merging those two pieces alone gives.  So the encoder walks left to right: it takes the longest piece that starts at
the position (an Aho-Corasick automaton's longest match), checks it against the piece before it by re-merging both,
falls back to the next shorter piece, and on failure marks the position as dead in a bitfield and steps back.  No piece
crosses a space inside it, so words are encoded apart, and frequent ones are remembered.

Defined results: a null or empty text has no ids and decodes to the empty string.  Characters outside the vocabulary
become byte pieces.  A literal U+2581 in a text is read as a space, as the library does.
"""

from __future__ import annotations

import functools
import heapq

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm.common import list_array, map_batches, texts_of

SPACE = "▁"
#: Words are remembered up to this length; at most so many recent ones, and as many from before those.
WORD_CHARS, WORDS_KEPT, PAIRS_KEPT = 48, 250_000, 200_000


def _lenient(found: bytearray) -> str:
    """UTF-8 where every byte that is no part of a character stands for itself as U+FFFD."""
    out, rest = [], bytes(found)
    while rest:
        try:
            out.append(rest.decode())
            break
        except UnicodeDecodeError as bad:
            out.append(rest[: bad.start].decode() + "\ufffd")
            rest = rest[bad.start + 1 :]
    return "".join(out)


class PieceCodec:
    """Encoder and decoder for one merge-type model file without a text-changing normaliser."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = {}
        special = set()
        for i in range(size):
            if model.is_byte(i):
                self.byte_id[int(self.text[i][3:5], 16)] = i
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                special.add(i)
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = model.unk_id()
        normal = [i for i in range(size) if i not in special]
        self.id_of = {self.text[i]: i for i in normal}
        # Pieces of spaces alone share one lowest priority, so ties go by position; they are merged after all others.
        runs = [i for i in normal if len(self.text[i]) > 1 and set(self.text[i]) == {SPACE}]
        others = [i for i in normal if i not in set(runs)]
        if any(SPACE in self.text[i][1:] for i in others):
            raise ValueError("a piece holds a space after its start")
        merged = [i for i in others if len(self.text[i]) > 1]
        if runs and merged and max(map(model.get_score, runs)) >= min(map(model.get_score, merged)):
            raise ValueError("pieces of spaces don't come last")
        self.run_ids = {self.text[i]: i for i in runs}
        order = sorted(merged, key=lambda i: -model.get_score(i))
        if len({model.get_score(i) for i in order}) != len(order):
            raise ValueError("two pieces share a priority")
        #: Merge priority by id, smaller first; single characters come before all merges.
        self.rank = {i: -1 for i in others} | {i: n for n, i in enumerate(order)}
        self.split: dict[int, tuple[int, int]] = {}
        reachable = {i for i in others if len(self.text[i]) == 1}
        for i in order:
            parts = self.merge(self.text[i])
            if len(parts) == 1:
                self.split[i] = self.last_merge
                reachable.add(i)
        self.automaton = ahocorasick.Automaton()
        for i in reachable:
            self.automaton.add_word(self.text[i], i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for i in reachable:
            text = self.text[i]
            for end in range(len(text) - 1, 0, -1):
                j = self.id_of.get(text[:end])
                if j in reachable:
                    self.shorter[i] = j
                    break
        self.size = [len(t) for t in self.text]
        self.pairs: dict[int, bool] = {}
        #: Character pairs that stand side by side in some piece; no merge ever crosses any other border.
        self.inside = {t[k : k + 2] for t in map(self.text.__getitem__, others) for k in range(len(t) - 1)}
        #: Remembered ids of words, with and without a space before them: the recent ones, and those before.
        self.recent: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.before: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        #: What each piece decodes to; an unknown one to the library's sign for it.
        self.shown = [" ⁇ " if i == self.unknown else t.replace(SPACE, " ") for i, t in enumerate(self.text)]
        self.newline_splits = "\n" not in {c for i in others for c in self.text[i]}

    def merge(self, word: str) -> list[int]:
        """Ids by plain priority merging, for building the tables; last_merge keeps the last pair joined."""
        parts = [self.id_of.get(c, -1) for c in word]
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                if parts[k] >= 0 and parts[k + 1] >= 0:
                    j = self.id_of.get(self.text[parts[k]] + self.text[parts[k + 1]])
                    if j is not None and j in self.rank and (best is None or self.rank[j] < self.rank[best]):
                        best, at = j, k
            if best is None:
                return parts
            self.last_merge = (parts[at], parts[at + 1])
            parts[at : at + 2] = [best]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces together gives exactly these two pieces.

        Both are taken apart again in reverse order of their merges; if a pair across the border would have been joined
        before the merge just undone, the pieces can't stand side by side.
        """
        rank, split, id_of, text = self.rank, self.split, self.id_of, self.text
        a, b, ok = left, right, True
        limit = (1 << 60, 0)  # undone merge: priority, and 1 if it lies right of the border
        while True:
            joined = id_of.get(text[a] + text[b])
            if joined is not None and joined in rank and (rank[joined], 0.5) < limit:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # at equal priority the right one was merged later
                limit = (ra, 0)
                a = split[a][1]
            else:
                limit = (rb, 1)
                b = split[b][0]
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[left << 20 | right] = ok
        return ok

    def backtrack(self, word: str) -> list[int]:
        """Ids of a word of vocabulary characters that has at most one space, at its start."""
        n, iter_long, size, shorter, pairs = len(word), self.automaton.iter_long, self.size, self.shorter, self.pairs
        alive = bytearray(b"\1") * (n + 1)
        ids: list[int] = []
        pos, token = 0, next(iter_long(word))[1]
        while True:
            last = ids[-1] if ids else -1
            while True:
                end = pos + size[token]
                if alive[end]:
                    if last < 0:
                        break
                    ok = pairs.get(last << 20 | token)
                    if ok if ok is not None else self.compatible(last, token):
                        break
                token = shorter.get(token, -1)
                if token < 0:
                    break
            if token >= 0:
                ids.append(token)
                pos = end
                if pos == n:
                    return ids
                token = next(iter_long(word, pos))[1]
            else:
                alive[pos] = 0
                token = ids.pop()
                pos -= size[token]

    @functools.lru_cache(4096)  # noqa: B019
    def spaces(self, count: int) -> tuple[int, ...]:
        """Ids of a run of spaces: equal priorities, so always the leftmost pair that makes a piece."""
        one = self.id_of[SPACE]
        parts: list[int | None] = [one] * count
        right = list(range(1, count + 1))
        left = list(range(-1, count - 1))
        heap = list(range(count - 1))
        while heap:
            at = heapq.heappop(heap)
            if parts[at] is None or (to := right[at]) >= count or parts[to] is None:
                continue
            j = self.run_ids.get(self.text[parts[at]] + self.text[parts[to]])
            if j is None:
                continue
            parts[at], parts[to] = j, None
            right[at] = right[to]
            if right[at] < count:
                left[right[at]] = at
            for x in (left[at], at):
                if x >= 0:
                    heapq.heappush(heap, x)
        return tuple(i for i in parts if i is not None)

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch without inner spaces; characters outside the vocabulary split it."""
        id_of, ids, start = self.id_of, [], 0
        for k, c in enumerate(word):
            if c not in id_of:
                if k > start:
                    ids += self.backtrack(word[start:k])
                ids += [self.byte_id.get(b, self.unknown) for b in c.encode("utf-8", "replace")]
                start = k + 1
        if start < len(word):
            ids += self.backtrack(word[start:])
        return ids

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces read as UTF-8, and the space before the first word taken away."""
        shown = self.shown
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([shown[i] for i in ids])[1:]
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(_lenient(pending))
                pending.clear()
            out.append(shown[i])
        if pending:
            out.append(_lenient(pending))
        return "".join(out)[1:]

    def miss(self, word: str, spaced: int) -> bytes:
        """int32 ids of a word that isn't among the recent ones."""
        recent, before = self.recent[spaced], self.before[spaced]
        found = before.get(word)
        if found is None:
            whole, start, parts = SPACE + word if spaced else word, 0, []
            for k in range(1, len(whole)):
                if whole[k - 1 : k + 1] not in self.inside:
                    parts.append(whole[start:k])
                    start = k
            parts.append(whole[start:])
            ids = [i for p in parts for i in self.encode_word(p)] if len(parts) < 3 or len(whole) <= WORD_CHARS else self.encode_long(parts)
            found = np.asarray(ids, np.int32).tobytes()
        if len(word) <= WORD_CHARS:
            if len(recent) >= WORDS_KEPT:
                self.before, self.recent = self.recent, ({}, {})
                recent = self.recent[spaced]
            recent[word] = found
        return found

    def encode_long(self, parts: list[str]) -> list[int]:
        known: dict[str, list[int]] = {}
        ids: list[int] = []
        for p in parts:
            if p not in known:
                known[p] = self.encode_word(p)
            ids += known[p]
        return ids

    def run_then(self, count: int, word: str) -> bytes:
        """count spaces and then a word: the word takes the last space if it merges with it."""
        one = self.id_of[SPACE]
        ids = np.frombuffer(self.recent[1].get(word) or self.miss(word, 1), np.int32).tolist() if word else [one]
        ids = [*self.spaces(count), *ids[1:]] if ids[0] == one else [*self.spaces(count - 1), *ids]
        return np.asarray(ids, np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """int32 ids of the whole text."""
        if not text:
            return np.zeros(0, np.int32)
        miss = self.miss
        found: list[bytes] = []
        text = text.replace(SPACE, " ")
        for n, line in enumerate(text.split("\n") if self.newline_splits else [text]):
            parts = line.split(" ")
            if n:  # no space stands before the first word of a later line
                found.append(self.recent[0].get("\n") or miss("\n", 0))
                first = parts.pop(0)
                if first:
                    found.append(self.recent[0].get(first) or miss(first, 0))
            if "" not in parts:
                get = self.recent[1].get
                found += [get(w) or miss(w, 1) for w in parts]
                continue
            empty = 0
            for w in parts:
                if not w:
                    empty += 1
                    continue
                found.append(self.run_then(empty + 1, w) if empty else self.recent[1].get(w) or miss(w, 1))
                empty = 0
            if empty:
                found.append(self.run_then(empty, ""))
        return np.frombuffer(b"".join(found), np.int32)


@functools.lru_cache(2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode_decode(docs: DataFrame, model_file: str, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row: the carried columns, ids array<int> of the whole text, and decoded, what the ids decode to.

    One narrow pass, no shuffle.  Null and empty texts give an empty array and '', an empty table no rows, and rows that
    repeat their own results.  The ids of every text are decoded.  Only the named columns are carried;
    they can't be called ids or decoded.
    """
    if {"ids", "decoded"} & set(carry):
        raise ValueError("carried columns can't be called ids or decoded")
    given = docs.select(*map(F.col, carry), F.col(text_col).alias("decoded"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = codec(model_file)
        ids = [each.encode(t) for t in texts_of(batch.column(len(carry)))]
        decoded = [each.decode(i.tolist()) for i in ids]
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], list_array(np.cumsum([0, *map(len, ids)]), flat), pa.array(decoded, pa.string())], names=[*carry, "ids", "decoded"])

    return map_batches(given, run, schema)

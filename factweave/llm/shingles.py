"""Words, word shingles and weighted (bag) MinHash signatures, vectorised over a batch of texts."""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_U64 = np.uint64
#: Odd multipliers of the shingle hash, from the splitmix64 sequence.
_GOLDEN = 0x9E3779B97F4A7C15
WORDS_KEPT = 100_000
#: Letters that are hashed at once.
BLOCK = 1 << 16
_known: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def word_hashes(text: str) -> list[int]:
    """64-bit hashes of the lower-case words of the whole text, in order."""
    get, out = _known.get, []
    words = WORD.findall(text.lower())
    for w in words:
        h = get(w)
        if h is None:
            if len(_known) >= WORDS_KEPT:
                _known.clear()
            h = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
            if len(w) <= 48:
                _known[w] = h
        out.append(h)
    return out


@functools.cache
def _in_words() -> np.ndarray:
    """Whether a code point belongs to a word, as in WORD."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts, in order, and how many words each text has.

    The words are those of WORD, their hashes others than those of word_hashes: sums over the letters of a hash of letter
    and place in the word, so that all words of about BLOCK letters are hashed at once.
    """
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _in_words()[codes]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        turns = np.concatenate(([0], turns))
    starts, stops = turns[::2], turns[1::2]  # the last letter is a line end, so every word has a stop
    letters = codes[inside]
    ends = np.cumsum(stops - starts)
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        at = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        first = np.concatenate(([at], ends[lo : hi - 1])) - at
        place = np.arange(ends[hi - 1] - at) - np.repeat(first, stops[lo:hi] - starts[lo:hi])
        each = mix(letters[at : ends[hi - 1]] * _U64(_GOLDEN) + (place.astype(np.uint64) + _U64(1)) * _U64(0xD1B54A32D192ED03))
        out[lo:hi] = mix(np.add.reduceat(each, first))
        lo = hi
    counts = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in lower)])))
    return out, counts


def shingles_of(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes of texts whose words stand one after another, and how many shingles each text has."""
    at = np.cumsum(counts) - counts
    sizes = np.where(counts >= size, counts - size + 1, counts > 0)
    to = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    full = shingle_hashes(words, size) if len(words) >= size else out[:0]
    long = counts >= size
    n = sizes[long]
    out[np.repeat(long, sizes)] = full[np.repeat(at[long] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    for k in range(1, size):
        of = counts == k
        if of.any():
            out[to[of]] = shingle_hashes(words[at[of][:, None] + np.arange(k)].T, k)[0]
    return out, sizes


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of `size` words; a shorter text is one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = mix(total + words[k : len(words) - size + 1 + k] + _U64((_GOLDEN * (k + 1)) & (2**64 - 1)))
    return total


def bag(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs."""
    return np.unique(shingle_hashes(np.array(word_hashes(text), np.uint64), size), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: sum of the smaller counts over sum of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def bag_signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_owners: int, registers: int) -> np.ndarray:
    """BagMinHash: signatures (n_owners, registers) whose registers agree with the probability of the weighted Jaccard.

    Weights are discretised to whole numbers.  Level l of a shingle carries its own Poisson process of points (value,
    register), and a text sees the processes of the levels below its count.  Processes are merged hierarchically: one
    process covers a dyadic interval of levels [2^j, 2^(j+1)) at the summed rate, and halving the interval again and
    again, by the bits of the point's hash, tells which level a point belongs to.  So a count of w needs log2 w
    processes.  Points come in ascending order, and only those under a limit that fills all registers are generated;
    a text whose registers weren't all filled gets a higher limit.  Each register keeps the identity of its least point.
    """
    out = np.zeros((n_owners, registers), np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n_owners)
    todo = np.flatnonzero(total)
    reach = np.log(registers) + 3.0
    # Dyadic intervals: interval 0 is level 0, interval j covers levels 2^(j-1) .. 2^j - 1.
    top = np.where(weight > 1, np.floor(np.log2(np.maximum(weight - 1, 1))).astype(np.int64) + 1, 0)
    counts = top + 1
    row = np.repeat(np.arange(len(owner)), counts)
    interval = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    u_owner, u_weight = owner[row], weight[row]
    width = np.where(interval > 0, 1 << np.maximum(interval - 1, 0), 1)
    seed = mix(shingle[row] + interval.astype(np.uint64) * _U64(_GOLDEN))
    while len(todo):
        limit = np.zeros(n_owners)
        limit[todo] = reach / total[todo]
        live = np.flatnonzero(limit[u_owner] > 0)
        # Of each live process: where it stands, how far it goes, what its gaps are divided by, and its seed.
        value, most, rate, root = np.zeros(len(live)), limit[u_owner[live]], (width[live] * registers).astype(np.float64), seed[live]
        step, ons, values, hashes = 0, [], [], []
        while len(live):
            # The next points of each live process: several at once when few processes are left.
            ahead = max(1, min(64, 4096 // len(live)))
            steps = np.arange(step + 1, step + 1 + ahead, dtype=np.uint64) * _U64(0xD1B54A32D192ED03)
            step += ahead
            h = mix(root + steps[0] if ahead == 1 else root[:, None] + steps[None, :])
            gap = np.log(((h >> _U64(11)).astype(np.float64) + 0.5) / 2.0**53)
            if ahead == 1:
                value = value - gap / rate
                more = np.flatnonzero(value < most)
                live, value, most, rate, root = live[more], value[more], most[more], rate[more], root[more]
                ons.append(live)
                values.append(value)
                hashes.append(h[more])
            else:
                points = value[:, None] - np.cumsum(gap / rate[:, None], axis=1)
                unit, k = np.nonzero(points < most[:, None])
                ons.append(live[unit])
                values.append(points[unit, k])
                hashes.append(h[unit, k])
                more = np.flatnonzero(points[:, -1] < most)
                live, value, most, rate, root = live[more], points[more, -1], most[more], rate[more], root[more]
        on, val = np.concatenate(ons), np.concatenate(values)
        name = mix(np.concatenate(hashes) + _U64(0x632BE59BD9B4E019))
        # Level 0 is in all texts with the shingle, and a point of a wider interval in those whose count is above its level.
        wide = np.flatnonzero(interval[on] > 0)
        level = width[on[wide]] + (name[wide] & (width[on[wide]] - 1).astype(np.uint64)).astype(np.int64)
        unseen = wide[level >= u_weight[on[wide]]]
        if len(unseen):
            seen = np.ones(len(on), bool)
            seen[unseen] = False
            on, val, name = on[seen], val[seen], name[seen]
        slot = u_owner[on] * registers + ((name >> _U64(40)) % _U64(registers)).astype(np.int64)
        least = np.full(n_owners * registers, np.inf)
        np.minimum.at(least, slot, val)
        first = np.flatnonzero(val == least[slot])
        flat = np.zeros(n_owners * registers, np.uint64)
        flat[slot[first]] = name[first]
        filled = np.isfinite(least).reshape(n_owners, registers).sum(axis=1)
        full = todo[filled[todo] == registers]
        out[full] = flat.reshape(n_owners, registers)[full]
        todo = todo[filled[todo] < registers]
        reach *= 2
    return out

"""Language identification by a small byte convolutional network, trained in numpy.

Texts are read whole, as windows of `WINDOW` bytes (the last one padded with zero bytes).  Filters of widths 2, 3 and 4
slide over byte embeddings, each filter's largest response over the window is kept, and a softmax over these gives the
window's language probabilities.  A text's probabilities are the byte-weighted mean over its windows.

At prediction time embeddings and filters are folded into lookup tables for byte pairs and single bytes, so a response is
the sum of one or two table rows; windows of a batch are stacked and run a few hundred at a time.

Training reads a bounded sample: of the `max_languages` most frequent languages about `per_language` texts each, chosen by
hash of the id, and at most `windows_each` windows of each text and one cut short.

Defined results: `und` with score 1 for null texts and texts without a letter; without training rows all texts are `und`
with score 0; ties go to the language first in order; rows that repeat keep their own results, an empty table gives no
rows, and other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import map_batches, share_of_hash, texts_of

WINDOW, STEP = 192, 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # for each width: width x EMBED x FILTERS
    bias: np.ndarray  # all filters
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width: responses to byte pairs (65,536 rows) and single bytes (256), by place in the filter."""
        singles = [[(self.embed @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]
        folded = []
        for rows in singles:
            parts = [(rows[k][:, None, :] + rows[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, len(rows) - 1, 2)]
            folded.append(parts + ([rows[-1]] if len(rows) % 2 else []))
        return folded

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """windows: n x WINDOW bytes; returns n x languages."""
        done = []
        for start in range(0, len(windows), STEP):
            w = windows[start : start + STEP]
            pair = w[:, :-1].astype(np.int32) * 256 + w[:, 1:]
            pooled = []
            for width, parts in zip(WIDTHS, tables, strict=True):
                n = WINDOW - width + 1
                total = parts[0][pair[:, :n]]
                if width > 2:
                    total += parts[1][pair[:, 2 : 2 + n]] if width == 4 else parts[1][w[:, 2 : 2 + n]]
                pooled.append(total.max(axis=1))
            z = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            done.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(done) if done else np.zeros((0, len(self.languages)))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text each belongs to, and how many bytes it holds."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    starts = (np.cumsum(counts) - counts) * WINDOW
    for t, at in zip(texts, starts.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.minimum(WINDOW, np.repeat(sizes, counts) - place * WINDOW)
    return flat.reshape(-1, WINDOW), owner, held


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 7) -> Network:
    """Adam on the cross-entropy; the gradient of the pooling goes to each filter's largest response."""
    rng = np.random.default_rng(seed)
    n_out = len(WIDTHS) * FILTERS
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "bias": np.zeros(n_out),
        "out": rng.normal(0, 0.1, (n_out, len(languages))),
        "out_bias": np.zeros(len(languages)),
    }
    for k, width in enumerate(WIDTHS):
        p[f"filter{k}"] = rng.normal(0, 1 / np.sqrt(width * EMBED), (width, EMBED, FILTERS))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            w, y = windows[rows], labels[rows]
            x = p["embed"][w]
            pooled, best = [], []
            for k, width in enumerate(WIDTHS):
                n = WINDOW - width + 1
                r = sum(x[:, j : j + n] @ p[f"filter{k}"][j] for j in range(width))
                at = r.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, axis=1) + p["bias"]
            a = np.maximum(h, 0)
            z = a @ p["out"] + p["out_bias"]
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(len(rows)), y] -= 1
            d /= len(rows)
            g = {"out": a.T @ d, "out_bias": d.sum(axis=0)}
            dh = (d @ p["out"].T) * (h > 0)
            g["bias"] = dh.sum(axis=0)
            g["embed"] = np.zeros_like(p["embed"])
            for k, width in enumerate(WIDTHS):
                dk, f = dh[:, k * FILTERS : (k + 1) * FILTERS], p[f"filter{k}"]
                gf = np.zeros_like(f)
                for j in range(width):
                    at = best[k] + j
                    seen = x[np.arange(len(rows))[:, None], at]  # rows x filters x EMBED
                    gf[j] = np.einsum("rf,rfe->ef", dk, seen)
                    np.add.at(g["embed"], w[np.arange(len(rows))[:, None], at], dk[:, :, None] * f[j].T[None])
                g[f"filter{k}"] = gf
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p["embed"], [p[f"filter{k}"] for k in range(len(WIDTHS))], p["bias"], p["out"], p["out_bias"])


def learn(docs: DataFrame, per_language: int = 400, windows_each: int = 6, max_languages: int = 1_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Network from rows with a language; None if there are none.

    The counts read only id and language.  The texts of the sample are cut where they lie; only windows come to the driver.
    """
    good = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    counts = good.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(lang_col) == r.lang, F.lit(min(1.0, per_language / r.n))).otherwise(share)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, windows = [], []
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            if not LETTER.search(text):
                continue
            data = text.encode("utf-8", "replace")
            rng = np.random.default_rng(zlib.crc32(data))  # the same windows wherever the text is read
            found, _, held = windows_of([data])
            found = found[(held >= 32) | (len(held) == 1)]
            pick = found[rng.permutation(len(found))[:windows_each]]
            # Short texts must be known too: a window cut after a few words.
            short = pick[:1].copy()
            short[:, int(rng.integers(16, 96)) :] = 0
            windows += [w.tobytes() for w in (*pick, *short)]
            languages += [lang] * (len(pick) + len(short))
        return pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    sample = good.where(share_of_hash(F.col(id_col), share)).select(F.col(lang_col).alias("lang"), F.col(text_col))
    rows = sorted((r.lang, bytes(r.window)) for r in map_batches(sample, cut, "lang string, window binary").collect())
    if not rows:
        return None
    languages = sorted({x for x, _ in rows})
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([languages.index(x) for x, _ in rows]), languages)


def identified(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each row's whole text; one narrow pass."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)
    cache: list[list[list[np.ndarray]]] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = shared.value
        texts = texts_of(batch.column(1))
        names, scores = ["und"] * len(texts), [0.0 if net is None else 1.0] * len(texts)
        if net is not None:
            if not cache:
                cache.append(net.tables())
            known = [k for k, t in enumerate(texts) if LETTER.search(t)]
            windows, owner, held = windows_of([texts[k].encode("utf-8", "replace") for k in known])
            total = np.zeros((len(known), len(net.languages)))
            np.add.at(total, owner, net.probabilities(windows, cache[0]) * held[:, None])
            for k, row in zip(known, total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9), strict=True):
                names[k], scores[k] = net.languages[int(row.argmax())], min(1.0, float(row.max()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, lang_pred string, score double")

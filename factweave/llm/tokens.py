"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are encoded whole, counted by length with map-side partial sums, and only the histogram (at most one row per
distinct length) goes on.  Suffix sums run in two levels, so no window puts the whole histogram into one task.

Defined results: null and empty texts have length 0.  Rows that repeat count each; rows of equal length are one row of the
histogram.  An empty table gives an empty histogram.  Other columns don't matter.
"""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import map_batches, texts_of

#: Lengths per block of the two-level sums.
BLOCK = 256


@functools.lru_cache(2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id column and n_tokens of each row's whole text."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoding(rank_file, pattern).encode_ordinary
        counts = []
        for text in texts_of(batch.column(1)):
            try:
                counts.append(len(encode(text)))
            except UnicodeEncodeError:  # a lone surrogate
                counts.append(len(encode(text.encode("utf-8", "replace").decode())))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[id_col, "n_tokens"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """n_tokens and n_docs for each distinct length."""
    return counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_report(hist: DataFrame) -> DataFrame:
    """For each distinct length L taken as a context limit: what fits, what is cut, and the share of documents at most L.

    n_docs: documents of exactly L; docs_up_to and tokens_up_to: those of at most L; docs_over and tokens_over: those
    longer; tokens_truncated: tokens that remain if all are cut to L; quantile: docs_up_to over all documents.
    Any other limit M gives tokens_up_to(L) + M * docs_over(L) with L the largest length of at most M.
    """
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    # Blocks number at most the longest encoded length / BLOCK, whatever the number of documents.
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_beyond"),
        F.sum("bd").over(whole).alias("all_docs"),
        F.sum("bt").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(beyond, "block").select(
        "n_tokens",
        "n_docs",
        "all_docs",
        "all_tokens",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_beyond")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens_beyond")).alias("tokens_over"),
    )
    return out.select(
        "n_tokens",
        "n_docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_up_to"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_up_to"),
        "docs_over",
        "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )

"""Cleaning pipeline over documents; each stage calls one training-data operator.

Stages take (spark, docs, sf_dir) and return a frame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, and any others that docs has.

Defined results, in every stage: a null or empty text is clean and stays (near_duplicates: each is a class of its own); rows with a null
id stay; rows that repeat meet the same fate, save that near_duplicates keeps one of them; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import decontam, neardup, pieces, pii, queries, toxicity
from factweave.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.7 or more; the grammar is learned from the labelled rows of the shared tables."""
    grammar = queries.toxicity_grammar(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, grammar)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, the one of the least id; where an id repeats, texts are classed one by one."""
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; items may be null, short or repeated."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind; n_chars follows the new text (null for a null one)."""
    out = pii.redacted(docs, pii.learn(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text and decodes it again: doc_id, lang, source, n_tokens, ids, round_trip (whether the decoded text is the text)."""
    coded = pieces.encode_decode(docs.withColumn("given", F.coalesce("text", F.lit(""))), queries.tokenizer_file("piece_bpe_32k.model"), ("doc_id", "lang", "source", "given"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("given")).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("pieces", pieces_stage),
]

#: The stages fit models and reach fixed points, which SQL can't express; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

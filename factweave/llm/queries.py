"""The queries opN_<name> over the shared tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import decontam, htmltext, langid, neardup, oracles, pieces, pii, quality, tokens, toxicity, urls
from factweave.llm.common import crc32_of, stored, table


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the operators take the path as a parameter."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.with_spans(docs.select("doc_id", "text"), pii.learn(docs)).select("doc_id", pii.in_order(F.col("found")).alias("found"))
    found = found.select("doc_id", "found", F.filter("found", lambda x: x["base"]).alias("base"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *(F.size(F.filter(base, pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("found")).alias("spans"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(crc32_of(F.col("doc_id")), F.lit(4))
    found = langid.identified(docs, langid.learn(docs.where(fold != 2)))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = importlib.import_module("public_tokenizers").PATTERN
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), pattern)
    hist = stored(tokens.length_histogram(counts), "lengths")  # read twice below; the texts are encoded once
    return tokens.context_report(hist)


def toxicity_grammar(docs: DataFrame, labels: DataFrame, max_train: int = 6_000) -> toxicity.Grammar:
    """Learned only from labelled rows outside the held-out third."""
    taught = F.pmod(crc32_of(F.col("doc_id")), F.lit(3)) != 1
    return toxicity.train(toxicity.with_text(labels, docs, taught, max_train), max_train)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity_grammar(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        F.coalesce(F.pmod(crc32_of(F.col("doc_id")), F.lit(3)) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"


#: Longest first; the rules' lengths differ wherever two can fit the same url.
_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
OP6_SQL = f"""
with parts as (
    select page_id,
           translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
    from pages
), ruled as (
    select *, case {" ".join(f"when {_fits(h, p)} then '{h}{p}'" for h, p, _ in _BY_LENGTH)} end as rule from parts
)
select page_id, host, path, rule,
       case {" ".join(f"when rule = '{h}{p}' then '{v}'" for h, p, v in _BY_LENGTH)} else 'allow' end as verdict
from ruled
"""


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans alone, which SQL can express: those columns of op1_personal_data."""
    docs = pii.with_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.filter("_candidates", lambda x: x["base"]).alias("base"))
    return docs.select("doc_id", *(F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals alone, which SQL can express: those columns of op8_quality."""
    return op8_quality(spark, sf_dir).drop("kept", "quality")


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_language": op2_language,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_url_rules": op6_url_rules,
    "op7_main_text": op7_main_text,
    "op8_quality": op8_quality,
    "op9_pieces": op9_pieces,
    "op10_near_duplicates": op10_near_duplicates,
    "personal_data_base": personal_data_base,
    "quality_base": quality_base,
}

ORACLE_SQL = {"op6_url_rules": OP6_SQL, "personal_data_base": oracles.PERSONAL_DATA_BASE, "quality_base": oracles.QUALITY_BASE}

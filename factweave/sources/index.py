"""A project's index: facts and search tables built from its sources, and brought up to date for files that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import schema
from factweave.extract import python
from factweave.operators import clones
from factweave.plans.storage import Scratch
from factweave.sources.store import FactStore
from factweave.streaming import state

#: Relations that sources give.
EXTRACTED = [r for r in schema.RELATIONS if r not in ("trace_flow", "func_summary", "entry_point_decorator", "entry_point_name", "entry_point_prefix", "file_revision", "file_namespace", "facts_meta")]


class Index:
    """Facts in a store, trigrams of symbol names beside them, and the revisions that they were made from."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.facts = spark, FactStore(spark, root)

    def refresh(self, files: DataFrame) -> DataFrame:
        """Takes the index to the given files (file_path, module_name, content, language): new and changed ones are extracted, deleted ones go.

        Returns file_path and status of every file.  Nothing is written where nothing changed.
        """
        kept = Scratch()
        now = files.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
        status = kept.packed(state.manifest_diff(self.facts.table("file_revision").select("file_path", "content_hash"), now.select("file_path", "content_hash")), "status")
        changed = status.where("status <> 'unchanged'")
        if changed.isEmpty():
            return status
        touched = now.join(changed.select("file_path"), "file_path", "left_semi")
        found = kept.put(python.extracted(touched), "extracted")
        given = {r.relation for r in found.select("relation").distinct().collect()}  # at most the number of relations
        tables = {r: python.relation(found, r) for r in EXTRACTED if r in given}
        tables["file_revision"] = touched.select("file_path", "content_hash", "language", "module_name", F.lit("disk").alias("origin"), F.lit(0).cast("long").alias("version"))
        self.facts.replace_files(changed.select("file_path"), tables)
        kept.drop(found)
        return status

    def status(self) -> DataFrame:
        """relation and number of rows of what the index holds."""
        parts = [self.facts.table(r).select(F.lit(r).alias("relation")) for r in ("symbol", "call", "reference", "file_revision")]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.groupBy("relation").agg(F.count("*").alias("n"))

    def search(self, text: str) -> DataFrame:
        """Qualified names that hold all trigrams of the text."""
        grams = clones.trigrams(self.facts.table("search_symbol"), "qualified_name", "name")
        return clones.trigram_search(grams, text)

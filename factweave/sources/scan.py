"""Files, lines and diffs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directories that a scan leaves out.
SKIP_DIRS = r"/(?:\.[^/]+|venv[^/]*|node_modules|dist|build|static|target)/"
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust"}


def files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """file_path, language, length, modified and content of the source files under root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    wanted = list(extensions or LANGUAGES)
    return (
        found.where(~F.col("path").rlike(SKIP_DIRS) & suffix.isin(wanted))
        .withColumn("language", language(F.col("path")))
        .select(F.col("path").alias("file_path"), "language", "length", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))
    )


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for ext, name in LANGUAGES.items():
        out = F.when(suffix == ext, name).otherwise(out)
    return out


def tracked(found: DataFrame, inventory: DataFrame) -> DataFrame:
    """Only the files that an inventory (file_path) lists."""
    return found.join(inventory.select("file_path").distinct(), "file_path", "left_semi")


def lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line (from 1) and text of each line."""
    return texts.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def diff_hunks(diff_lines: DataFrame) -> DataFrame:
    """Hunks of unified diffs: input diff_id, n (line number), line; output diff_id, file_path, old and new start and count.

    The file of a hunk is the last +++ header before it.
    """
    before = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 4096), r"^b/", ""))
    num = lambda g, d: F.coalesce(F.nullif(F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", g), F.lit("")).cast("long"), F.lit(d))
    seen = diff_lines.withColumn("file_path", F.last(header, ignorenulls=True).over(before))
    return seen.where(F.col("line").startswith("@@ ")).select(
        "diff_id", "file_path", num(1, 0).alias("old_start"), num(2, 1).alias("old_count"), num(3, 0).alias("new_start"), num(4, 1).alias("new_count")
    )


def picked(found: DataFrame, inventory: DataFrame | None, wanted: list[str] | None = None) -> DataFrame:
    """The files that an inventory lists where there is one, else all that a scan found; of the wanted languages."""
    out = found if inventory is None else tracked(found, inventory)
    return out if wanted is None else out.where(language(F.col("file_path")).isin(list(wanted)))

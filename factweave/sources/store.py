"""Fact store: one Parquet table per relation in a snapshot directory, published by a pointer.

A snapshot is written whole and then named by a small pointer table, so a failed update leaves the old one in place.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import schema


POINTER = "version long, relation string, path string"


class MappingStore:
    """Mappings of identifiers and modules between projects, in snapshots like those of facts; keys are source, target and both projects."""

    KEYS = ["source_project", "source", "target_project", "target"]
    KIND = "source_project string, source string, target_project string, target string, relationship string, evidence string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [x.getPath() for x in system.listStatus(path)] if system.exists(path) else []
        ok = lambda p: system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(p.getName()[1:]) for p in done if ok(p))

    def table(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(self.KIND).parquet(f"{self.root}/m{found[-1]:06d}") if found else self.spark.createDataFrame([], self.KIND)

    def _publish(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.root}/m{(self._versions() or [0])[-1] + 1:06d}")

    def put(self, new: DataFrame) -> None:
        """Adds mappings; those of the same key are replaced."""
        self._publish(upserted(self.table(), new, self.KEYS))

    def remove(self, gone: DataFrame) -> None:
        """Takes away the mappings of the given keys."""
        self._publish(self.table().join(gone.select(*self.KEYS).distinct(), self.KEYS, "left_anti").select(*self.table().columns))


class FactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- snapshots -------------------------------------------------------
    def current(self) -> str | None:
        """Name of the published snapshot."""
        where = self._where()
        return f"v{self._version(where):06d}" if where else None

    def _where(self) -> dict[str, tuple[int, str]]:
        """Version and path of each relation in the published snapshot."""
        if not self._exists(f"{self.root}/_current"):
            return {}
        rows = self.spark.read.schema(POINTER).parquet(f"{self.root}/_current").collect()
        last = max((r.version for r in rows), default=0)
        return {r.relation: (r.version, r.path) for r in rows if r.version == last}

    @staticmethod
    def _version(where: dict[str, tuple[int, str]]) -> int:
        return max((v for v, _ in where.values()), default=0)

    def _exists(self, path: str) -> bool:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath)

    def table(self, relation: str) -> DataFrame:
        """A relation of the published snapshot, or a copy of one in another order; empty if it has none."""
        base = schema.ALIASES.get(relation, relation)
        where = self._where().get(relation)
        if where is None:
            return self.spark.createDataFrame([], schema.RELATIONS[base])
        return self.spark.read.schema(schema.RELATIONS[base]).parquet(where[1])

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write the given relations, keys unique, as a new snapshot that takes all others from the one before, and make it current.

        Rows lie in the order of the key, dealt to files by ranges of it, so a search by key reads few files and row groups; `call` is
        written in the orders of its callee and file as well.  Of rows with one key the least is kept.
        """
        where = self._where()
        version = self._version(where) + 1
        name = f"v{version:06d}"
        paths = {r: p for r, (_, p) in where.items()}
        for relation, df in tables.items():
            kind = schema.RELATIONS[relation]
            keys, rest = schema.keys(relation), [f.name for f in kind if f.name not in schema.keys(relation)]
            rows = df.select(*(F.col(f.name).cast(f.dataType) for f in kind))
            rows = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_rest")).select(*keys, *(F.col(f"_rest.{c}").alias(c) for c in rest)) if rest else rows.distinct()
            orders = {relation: keys} | {copy: [schema.LEADING[copy], *(k for k in keys if k != schema.LEADING[copy])] for copy, base in schema.ALIASES.items() if base == relation}
            for copy, order in orders.items():
                paths[copy] = f"{self.root}/{name}/{copy}"
                rows.select(*(f.name for f in kind)).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(paths[copy])
        pointer = self.spark.createDataFrame([(version, r, p) for r, p in sorted(paths.items())], POINTER)
        pointer.coalesce(1).write.mode("append").parquet(f"{self.root}/_current")
        return name

    # -- updates ---------------------------------------------------------
    def upsert(self, changes: dict[str, DataFrame]) -> str:
        """Rows replace those of the same key; other relations are carried over unread."""
        return self.publish({r: upserted(self.table(r), new, schema.keys(r)) for r, new in changes.items()})

    def replace_files(self, paths: DataFrame, changes: dict[str, DataFrame]) -> str:
        """Drop every row of the given files (column file_path) and add the new rows, in one snapshot; relations without files are carried over unread."""
        tables = {}
        for relation in sorted({*self._where(), *changes} - {*schema.ALIASES}):
            if relation in changes or {"file_path", "importing_file"} & {*schema.RELATIONS[relation].names}:
                old = without_files(self.table(relation), paths)
                tables[relation] = old.unionByName(changes[relation]) if relation in changes else old
        return self.publish(tables)

    # -- JSON ------------------------------------------------------------
    def to_json(self, relations: Iterable[str] | None = None) -> DataFrame:
        """relation and fact: each row as a JSON object."""
        return tagged_json({r: self.table(r) for r in relations or schema.RELATIONS})

    def from_json(self, facts: DataFrame) -> dict[str, DataFrame]:
        """Inverse of to_json."""
        out = {}
        for relation, kind in schema.RELATIONS.items():
            rows = facts.where(F.col("relation") == relation).select(F.from_json("fact", kind).alias("x"))
            out[relation] = rows.select("x.*")
        return out


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(new.columns).unionByName(new)


def without_files(df: DataFrame, paths: DataFrame) -> DataFrame:
    column = next((c for c in ("file_path", "importing_file") if c in df.columns), None)
    return df if column is None else df.join(paths.select(F.col("file_path").alias(column)).distinct(), column, "left_anti").select(df.columns)


def tagged_json(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.select(F.lit(r).alias("relation"), F.to_json(F.struct(*df.columns)).alias("fact")) for r, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)

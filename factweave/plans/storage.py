"""Tables in the shared scratch folder: they end lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of a few numbers a row are read as one partition, and may be broadcast, up to this many rows.
SMALL_ROWS = 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one where that is unset, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = f"{scratch_dir(df.sparkSession)}/factweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._factweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that `stored` returned; nothing may read it afterwards."""
    path = getattr(df, "_factweave_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Stored tables that are deleted together; one that is kept for a result outlives them."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        out = stored(df, label)
        self.held.append(out)
        return out

    def packed(self, df: DataFrame, label: str) -> DataFrame:
        """A stored table; of at most SMALL_ROWS rows it is read as one partition, so that joins and sums of such
        tables need no shuffle."""
        out = self.put(df, label)
        rows = out.count()
        few = out.coalesce(1) if rows <= SMALL_ROWS else out
        few._factweave_path, few._factweave_rows = out._factweave_path, rows
        return few

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            discard(df)
        gone = {getattr(df, "_factweave_path", None) for df in frames}
        self.held = [df for df in self.held if df._factweave_path not in gone]

    def clear(self) -> None:
        self.drop(*self.held)


def is_small(df: DataFrame) -> bool:
    """True of a packed table that one task can read, and that may be broadcast."""
    return getattr(df, "_factweave_rows", SMALL_ROWS + 1) <= SMALL_ROWS


def together(df: DataFrame, *inputs: DataFrame) -> DataFrame:
    """df, a join or sum of packed tables, in one partition if all of them are small: further joins then need no shuffle."""
    if not all(is_small(x) for x in inputs):
        return df
    out = df.coalesce(1)
    out._factweave_rows = SMALL_ROWS
    return out

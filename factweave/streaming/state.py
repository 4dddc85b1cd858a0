"""State that follows a stream of revisions: overlays, manifests, deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path and status (new, deleted, changed, unchanged) of two manifests (file_path, content_hash)."""
    both = old.select("file_path", F.col("content_hash").alias("was")).join(new.select("file_path", F.col("content_hash").alias("now")), "file_path", "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return both.select("file_path", status.alias("status"))


def accept(current: tuple | None, update: tuple) -> bool:
    """Overlay rule over (owner, version, content): first, another owner's, a later version, or the same again."""
    if current is None or current[0] != update[0]:
        return True
    return update[1] > current[1] or (update[1], update[2]) == (current[1], current[2])


def closed(current: tuple | None, owner: str, version: int | None) -> bool:
    """Whether a close takes the overlay away: the same owner's, and no older than the version that is open (null: any)."""
    return current is not None and current[0] == owner and (version is None or version >= current[1])


def overlay_changes(updates: DataFrame) -> DataFrame:
    """Open overlays after updates and closes (file_path, seq, action, owner, version, content), in order of seq; stale ones are ignored."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        now = None
        for row in part.sort_values("seq").itertuples(index=False):
            if row.action == "close":
                now = None if closed(now, row.owner, None if pd.isna(row.version) else int(row.version)) else now
            else:
                new = (row.owner, row.version, row.content)
                now = new if accept(now, new) else now
        rows = [] if now is None else [(part["file_path"].iloc[0], *now)]
        return pd.DataFrame(rows, columns=["file_path", "owner", "version", "content"])

    return updates.groupBy("file_path").applyInPandas(fold, "file_path string, owner string, version long, content string")


def rescan(old: DataFrame, found: DataFrame) -> DataFrame:
    """file_path, stat and content_hash after a scan: files whose stat (length and time) is known keep their hash, others are hashed anew.

    old: file_path, stat, content_hash; found: file_path, stat, content.
    """
    known = old.select("file_path", "stat", F.col("content_hash").alias("was"))
    both = found.join(known, ["file_path", "stat"], "left")
    return both.select("file_path", "stat", F.coalesce("was", F.sha2(F.col("content").cast("binary"), 256)).alias("content_hash"))


def typed_view(facts: DataFrame, type_binding: DataFrame) -> DataFrame:
    """Facts (file_path, symbol_qn, line) with the type bound last at or before their line; null where none is."""
    from factweave.operators import ranges

    bound = type_binding.groupBy("file_path", "symbol_qn", F.col("line").alias("bound")).agg(F.max("type_str").alias("type_str"))
    return ranges.as_of(facts, bound, ["file_path", "symbol_qn"], "line", "bound", ["type_str"])


def overlay_fold(updates: DataFrame) -> DataFrame:
    """Current overlay of each file_path after its updates (seq, owner, version, content), in order of seq."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        now = None
        for row in part.sort_values("seq").itertuples(index=False):
            new = (row.owner, row.version, row.content)
            now = new if accept(now, new) else now
        return pd.DataFrame([(part["file_path"].iloc[0], *now)], columns=["file_path", "owner", "version", "content"])

    return updates.groupBy("file_path").applyInPandas(fold, "file_path string, owner string, version long, content string")


def overlay_stream(updates: DataFrame) -> DataFrame:
    """The same as a streaming operator: one row per accepted update."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.getOption, []
        for row in pd.concat(parts).sort_values("seq").itertuples(index=False):
            new = (row.owner, int(row.version), row.content)
            if accept(now, new):
                now = new
                out.append((key[0], *new))
        if now is not None:
            state.update(now)
        yield pd.DataFrame(out, columns=["file_path", "owner", "version", "content"])

    schema = "file_path string, owner string, version long, content string"
    return updates.groupBy("file_path").applyInPandasWithState(step, schema, "owner string, version long, content string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by time window and key; rows later than the watermark are dropped in a stream."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")

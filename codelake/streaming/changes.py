"""File changes: debounced batches, last operation per file, and their application to the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, keys: list[str], time: str = "ts", gap: str = "2 seconds") -> DataFrame:
    """(keys, start, end, n_events): runs of events of a key with no pause longer than the gap, which both ends share.

    Works on batches and, behind a watermark, on streams. Events without a time belong to no session.
    """
    window = F.session_window(F.col(time), gap)
    return events.where(F.col(time).isNotNull()).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def last_operations(events: DataFrame, keys: list[str], path: str, operation: str, time: str, order: str, gap: str = "2 seconds") -> DataFrame:
    """(keys, path, session start, op): per debounced run the last operation on each path, by (time, order)."""
    runs = sessions(events, keys, time, gap)
    named = events.where(F.col(time).isNotNull()).alias("e").join(runs.alias("r"), keys).where((F.col(f"e.{time}") >= F.col("r.start")) & (F.col(f"e.{time}") < F.col("r.end")))
    return named.groupBy(*keys, F.col("r.start").alias("start"), path).agg(F.max_by(operation, F.struct(F.col(f"e.{time}"), order)).alias("op"))


def flattened(events: DataFrame) -> DataFrame:
    """Move events as a deletion of the old and a modification of the new path; folders drop out, created counts as modified."""
    ops = F.when(F.col("op") == "moved", F.array(F.struct(F.lit("deleted").alias("op"), F.col("file_path").alias("file_path")), F.struct(F.lit("modified").alias("op"), F.col("dest_path").alias("file_path"))))
    one = F.array(F.struct(F.when(F.col("op") == "created", "modified").otherwise(F.col("op")).alias("op"), F.col("file_path").alias("file_path")))
    return events.where("not coalesce(is_folder, false)").select("seq", "ts", F.explode(F.coalesce(ops, one)).alias("x")).select("seq", "ts", "x.*").where("file_path is not null")


def debounced(stream: DataFrame, key: str, time: str = "ts", gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """The sessions of a stream, each emitted once the watermark has passed its end."""
    return sessions(stream.withWatermark(time, lateness), [key], time, gap)


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs ``apply(deleted, modified)`` on each micro-batch's last operation per path; a path both deleted and made again is modified."""

    def batch(events: DataFrame, _: int) -> None:
        last = events.groupBy("file_path").agg(F.max_by("op", "seq").alias("op")).persist()
        try:
            apply(last.where("op = 'deleted'").select("file_path"), last.where("op != 'deleted'").select("file_path"))
        finally:
            last.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

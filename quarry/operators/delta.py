"""Changes of tables as functions from frames to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks with an unknown id or another hash."""
    return new.join(stored.select("Id", F.coalesce("ContentHash", F.lit("")).alias("ContentHash")), ["Id", "ContentHash"], "left_anti")


def last_wins(batch: DataFrame, order: str) -> DataFrame:
    """Of rows with one Id, the last in order."""
    w = Window.partitionBy("Id").orderBy(F.desc(order))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str = "Id") -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks if not path.strip() else chunks.where(F.col("FilePath") != path)


def delete_missing(chunks: DataFrame, present: DataFrame) -> DataFrame:
    """Chunks of files that present (FilePath) lists."""
    return chunks.join(present.select("FilePath").distinct(), "FilePath", "left_semi")


def debounce(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """The last event of each run of a key's events that are less than gap apart: (key, fired_at, n_events)."""
    runs = events.groupBy(key, F.session_window(ts, gap)).agg(F.max(ts).alias("fired_at"), F.count("*").alias("n_events"))
    return runs.select(key, "fired_at", "n_events")

"""Event-time debounce as a stream: a key's run of events fires once it has been quiet for a while."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, ts: str, quiet: str, late: str = "0 seconds") -> DataFrame:
    """key, fired_at (the run's last event), n_events of each run that the watermark has passed.

    State holds open runs only. Events that come more than `late` after newer ones are dropped. Watermarks need
    instants, so times without a zone are taken in the session's and given back without one.
    """
    timed = events.select(key, F.col(ts).cast("timestamp").alias("_at"))
    runs = timed.withWatermark("_at", late).groupBy(key, F.session_window("_at", quiet)).agg(F.max("_at").alias("fired_at"), F.count("*").alias("n_events"))
    return runs.select(key, F.col("fired_at").cast(events.schema[ts].dataType).alias("fired_at"), "n_events")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one; on this machine only where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix='quarry-stream-')}"


def drain(stream: DataFrame, root: str) -> DataFrame:
    """Run a stream over all that is there now and read what it appended; running it again with this root goes on from there."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{root}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")

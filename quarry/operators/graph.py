"""The call graph: callers, callees, impact and resolution of call targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def callers(chunks: DataFrame, edges: DataFrame, chunk_id: str) -> DataFrame:
    """The chunks that call it, a row per edge."""
    own = edges.where(F.col("TargetChunkId") == chunk_id).select(F.col("SourceChunkId").alias("Id"), "CallType", "LineNumber")
    return chunks.join(own, "Id").orderBy("LineNumber", "Id")


def callees(chunks: DataFrame, edges: DataFrame, chunk_id: str) -> DataFrame:
    own = edges.where(F.col("SourceChunkId") == chunk_id).select(F.col("TargetChunkId").alias("Id"), "CallType", "LineNumber")
    return chunks.join(own, "Id").orderBy("LineNumber", "Id")


def impact_radius(edges: DataFrame, chunk_id: str, depth: int = 3) -> DataFrame:
    """id, depth of all that reach the chunk over at most depth edges, by widening a frontier; the chunk itself isn't one.

    The lineage is cut by a checkpoint each step where the session has a folder for it.
    """
    spark = edges.sparkSession
    back = edges.select(F.col("TargetChunkId").alias("to"), F.col("SourceChunkId").alias("id")).distinct()
    seen = frontier = spark.createDataFrame([(chunk_id, 0)], "id string, depth int")
    for step in range(1, depth + 1):
        frontier = back.join(frontier.select(F.col("id").alias("to")), "to").select("id").distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(step))
        if spark.conf.get("spark.checkpoint.dir", None):
            frontier = frontier.checkpoint()
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def live_edges(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = chunks.select("Id")
    return edges.join(ids, F.col("SourceChunkId") == F.col("Id"), "left_semi").join(ids, F.col("TargetChunkId") == F.col("Id"), "left_semi")


def resolve_calls(chunks: DataFrame) -> DataFrame:
    """Edges from CallsTo: the chunk whose qualified name it is, else the first (by Id) with the last segment in its name."""
    named = chunks.select(F.col("Id").alias("target"), F.concat_ws(".", "NamespaceName", "ClassName", "MemberName").alias("full"))
    calls = chunks.select(F.col("Id").alias("source"), F.explode(F.array_distinct("CallsTo")).alias("call")).withColumn("last", F.element_at(F.split("call", r"\."), -1))
    exact = calls.join(named.groupBy("full").agg(F.min("target").alias("exact")), F.col("call") == F.col("full"), "left")
    segments = named.select("target", F.explode(F.slice(F.split("full", r"\."), 2, 1000)).alias("segment")).groupBy("segment").agg(F.min("target").alias("near"))
    found = exact.join(segments, F.col("last") == F.col("segment"), "left").select("source", F.coalesce("exact", "near").alias("target"))
    return found.where("target IS NOT NULL").select(F.col("source").alias("SourceChunkId"), F.col("target").alias("TargetChunkId"), F.lit("Invocation").alias("CallType"), F.lit(None).cast("int").alias("LineNumber")).distinct()

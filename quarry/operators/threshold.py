"""Adaptive score thresholds, on columns or on the few scores of one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.schemas import ThresholdOptions


def length_part(query: str, floor: float) -> float:
    words = [w for w in query.replace("_", " ").split(" ") if w]
    return {1: floor, 2: 0.40}.get(len(words), 0.60)


def adaptive(scores: list[float], query: str, o: ThresholdOptions = ThresholdOptions()) -> float:
    if not o.enabled or not scores:
        return o.floor
    ranked = sorted(scores, reverse=True)
    at = min(int(o.percentile / 100 * len(ranked)), len(ranked) - 1)
    gaps = [a - b for a, b in zip(ranked, ranked[1:], strict=False)]
    after = ranked[gaps.index(max(gaps)) + 1] if gaps else ranked[0]
    value = 0.4 * ranked[at] + 0.3 * after + 0.3 * length_part(query, o.floor)
    return min(max(value, o.floor), o.ceiling)


def adaptive_frame(scores: DataFrame, column: str, query: str, o: ThresholdOptions = ThresholdOptions()) -> DataFrame:
    """One row: percentile, gap, threshold of a result's scores (one result: at most top-k rows)."""
    w = Window.partitionBy().orderBy(F.desc(column))
    ranked = scores.select(F.col(column).alias("s"), F.lead(column).over(w).alias("after"), F.row_number().over(w).alias("pos"))
    n = F.count("*")
    at = F.least(F.floor(F.lit(o.percentile / 100) * n), n - 1).cast("int")
    row = ranked.agg(F.sort_array(F.collect_list("s"), asc=False)[at].alias("percentile"), F.coalesce(F.max_by("after", F.when(F.col("after").isNotNull(), F.struct((F.col("s") - F.col("after")).alias("g"), (-F.col("pos")).alias("p")))), F.max("s")).alias("gap"))
    value = 0.4 * F.col("percentile") + 0.3 * F.col("gap") + F.lit(0.3 * length_part(query, o.floor))
    return row.withColumn("threshold", F.coalesce(F.least(F.greatest(value, F.lit(o.floor)), F.lit(o.ceiling)), F.lit(o.floor)))

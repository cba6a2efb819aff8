"""Exact top-k inner products by a Voronoi kNN join (after Lu et al., PVLDB 2012).

Each vector goes to the cell of its nearest pivot; cells are dealt in parts of a bounded size, so that a cell
may hold any share of the rows. Summaries give each cell's size and its largest distance from the pivot. A
query's inner product with a cell's vectors lies within q.pivot +- |q| * radius. First every query meets the
cells that promise most until these hold k vectors: the k-th score found is a lower bound of its result. Then
it is sent to the other cells whose upper bound reaches that score, to each of their parts, and solved there.
The driver holds pivots and summaries only, a row per pivot.

Vectors become whole numbers, floor(scale * x), and scores are exact integers.

Results on unusual input: vectors that are null, empty or hold null or non-finite components take no part, nor
do rows without vec_id. Shorter vectors are filled up with zeros. Rows that share a vec_id are candidates each,
and none of them is a candidate of the query with that id; of several queries with one vec_id, one is answered.
Fewer candidates than k give all. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Workspace

SLACK = 1e-6


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<i8") for x in column.to_pylist()]) if len(column) else np.zeros((0, 0), np.int64)


def _cells(pivots: np.ndarray, width: int):
    """vec_id, cell, distance from its pivot, and the vector filled up to a common width."""
    schema = pa.schema([("vec_id", pa.int64()), ("cell", pa.int32()), ("distance", pa.float64()), ("v", pa.binary()), ("is_query", pa.bool_())])
    squares = (pivots.astype(np.float64) ** 2).sum(1)

    def run(batches):
        for batch in batches:
            ids, rows, wanted = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            if not rows:
                continue
            x = np.zeros((len(rows), width), np.int64)
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            far = (x.astype(np.float64) ** 2).sum(1)[:, None] - 2.0 * x.astype(np.float64) @ pivots.T.astype(np.float64) + squares
            cell = far.argmin(1)
            distance = np.sqrt(((x - pivots[cell]).astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cell.astype(np.int32)), pa.array(distance), pa.array([v.tobytes() for v in x.astype("<i8")], pa.binary()), wanted], schema=schema)

    return run


class Summary:
    """Of all cells: number, size, parts and radius."""

    def __init__(self, rows, pivots: np.ndarray):
        self.cell = np.array([r.cell for r in rows], np.int64)
        self.size = np.array([r.n for r in rows], np.int64)
        self.parts = [r.parts for r in rows]
        self.radius = np.array([r.radius for r in rows], np.float64)
        self.pivots = pivots.astype(np.float64)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(np.float64)
        centre = (q @ self.pivots.T)[:, self.cell]
        swing = np.sqrt((q**2).sum(1))[:, None] * self.radius
        slack = SLACK * (1 + np.abs(centre) + swing)
        return centre - swing - slack, centre + swing + slack


def _send(out: tuple[list, list, list, list], summary: Summary, cells, key: int, v: bytes) -> None:
    """A copy of the query for each part of the cells."""
    for j in cells:
        for part in range(summary.parts[j]):
            for column, value in zip(out, (summary.cell[j], part, key, v), strict=True):
                column.append(value)


def _promising(summary: Summary, k: int):
    """Each query with the cells of highest upper bounds that together hold k vectors besides itself."""
    schema = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("query_id", pa.int64()), ("v", pa.binary())])

    def run(batches):
        for batch in batches:
            if not len(batch.column(0)):
                continue
            _, high = summary.bounds(_vectors(batch.column(1)))
            out = ([], [], [], [])
            for i, (key, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                order = np.argsort(-high[i], kind="stable")
                need = int(np.searchsorted(np.cumsum(summary.size[order]), k + 1)) + 1
                _send(out, summary, order[:need], key, v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _remaining(summary: Summary, k: int):
    """Each query with the further cells that can reach its k-th score so far."""
    schema = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("query_id", pa.int64()), ("v", pa.binary())])

    def run(batches):
        for batch in batches:
            if not len(batch.column(0)):
                continue
            _, high = summary.bounds(_vectors(batch.column(1)))
            out = ([], [], [], [])
            for i, (key, v, least) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                order = np.argsort(-high[i], kind="stable")
                need = int(np.searchsorted(np.cumsum(summary.size[order]), k + 1)) + 1
                _send(out, summary, [j for j in order[need:] if least is None or high[i, j] >= least], key, v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _solve(k: int):
    """Rows come ordered by part, the part's vectors before its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        held, ids, vectors, data = None, [], [], None
        for batch in batches:
            cells, parts, roles, keys, vs = (batch.column(i).to_pylist() for i in range(5))
            out = ([], [], [])
            for place, role, key, v in zip(zip(cells, parts, strict=True), roles, keys, vs, strict=True):
                if place != held:
                    held, ids, vectors, data = place, [], [], None
                if role == 0:
                    ids.append(key)
                    vectors.append(np.frombuffer(v, "<i8"))
                    continue
                if data is None:
                    order = np.argsort(np.array(ids, np.int64), kind="stable")
                    known, data = np.array(ids, np.int64)[order], np.stack(vectors)[order] if ids else np.zeros((0, 1), np.int64)
                if not len(known):
                    continue
                score = data @ np.frombuffer(v, "<i8")
                score_of, id_of = score[known != key], known[known != key]
                if len(score_of) > k:
                    floor = np.partition(score_of, len(score_of) - k)[len(score_of) - k]
                    some = np.flatnonzero(score_of >= floor)  # ids ascend, so ties keep the smaller ones
                    some = some[np.lexsort((id_of[some], -score_of[some]))][:k]
                else:
                    some = np.arange(len(score_of))
                out[0].extend([key] * len(some))
                out[1].extend(id_of[some].tolist())
                out[2].extend(score_of[some].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    return run


def _meet(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = data.select("cell", "part", F.lit(0).alias("role"), F.col("vec_id").alias("key"), "v").unionByName(queries.select("cell", "part", F.lit(1).alias("role"), F.col("query_id").alias("key"), "v"))
    dealt = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "role")
    return dealt.mapInArrow(_solve(k), "query_id long, vec_id long, score long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Each query's k best; a part of a query's rows is cut to k first, where the rows are made."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def knn_join(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = 64, part_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest integer inner products over all other rows.

    vectors: vec_id and embedding. pivots: how many cells at most; a part holds about part_rows vectors.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "knn")
    parts_of = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists(parts_of, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(parts_of, lambda x: F.floor(x * scale).cast("long"))
    clean = vectors.where("vec_id IS NOT NULL").where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("w"), is_query.alias("is_query"))
    clean = work.save(clean, "whole")
    head = clean.agg(F.max(F.size("w")).alias("width"), F.count("*").alias("n")).first()
    if not head.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = clean.select("w").distinct().orderBy(F.xxhash64("w"), "w").limit(pivots).collect()  # at most `pivots` rows
    centres = np.zeros((len(chosen), head.width), np.int64)
    for i, r in enumerate(chosen):
        centres[i, : len(r.w)] = r.w
    celled = work.save(clean.select("vec_id", "w", "is_query").mapInArrow(_cells(centres, head.width), "vec_id long, cell int, distance double, v binary, is_query boolean"), "cells")
    rows = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")).orderBy("cell").collect()  # a row per pivot
    summary = Summary(rows, centres)
    parts = F.element_at(F.create_map(*(F.lit(x) for r in rows for x in (r.cell, r.parts))), F.col("cell"))
    data = celled.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))

    queries = data.where("is_query").select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    first = work.save(_top(_meet(data, queries.mapInArrow(_promising(summary, k), "cell int, part int, query_id long, v binary"), k), k).drop("rank"), "first")
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    known = queries.join(least, "query_id", "left").select("query_id", "v", "least")
    second = _meet(data, known.mapInArrow(_remaining(summary, k), "cell int, part int, query_id long, v binary"), k)
    return _top(first.unionByName(second), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

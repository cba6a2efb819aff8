"""Shared pieces: the shared work folder, saved tables, and connected components."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])
#: Used only where the session names no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/quarry"


#: Python workers give large blocks back to the system when they are freed.
MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "8388608"}


#: Bytes of an Arrow batch, unless an operator asks for others.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Let Python workers find this package, and keep their Arrow batches small.

    Batches are cut by bytes, so that one with very long texts stays within a worker's memory.
    """
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    env |= {k: v for k, v in MEMORY.items() if k not in env}
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{LOCAL_CHECKPOINTS}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """A folder of its own below the shared one. Tables written here cut the lineage.

    The folder goes when the JVM ends; drop() removes what the result doesn't read.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again. The shuffle files that writing it took go at once."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        kept = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            df.write.parquet(self.path(name))
        finally:
            self.spark.conf.unset(key) if kept is None else self.spark.conf.set(key, kept)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(self.path(name)), True)

    def mkdir(self, name: str) -> str:
        self._fs.mkdirs(self._path(self.path(name)))
        return self.path(name)


def give_back(spark: SparkSession | None = None) -> None:
    """Return this process's free memory to the system, after work on large arrays; with a session, its JVM's too.

    The JVM's collection also lets Spark remove broadcasts and shuffle files of steps that are over.
    """
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Let the driver and each executor return what the steps before left free: a JVM keeps its heap as wide as it once was.

    A small job has a task for each executor, which collects its JVM's garbage. They are dealt in turn to executors that are idle,
    so this belongs between steps. One that is missed only stays as it is.
    """
    give_back(spark)
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


#: What a Python worker keeps from task to task, by name. Workers go on from one step to the next.
HELD: dict[str, object] = {}


def let_go() -> None:
    """Drop what earlier steps left in this worker; for tasks that keep nothing."""
    if HELD:
        HELD.clear()
        give_back()


#: A table is broadcast if its rows take at most so many bytes.
BROADCAST_BYTES = 6 << 20


def rows_within(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows, of fixed width or keys of 16 bytes, take at most limit bytes. df is a saved table: this is a count."""
    width = 8 + sum({"bigint": 8, "double": 8, "int": 4, "boolean": 1, "binary": 24}[f.dataType.simpleString()] for f in df.schema)
    return df.count() * width <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast where it is within the limit; beyond, Spark chooses the join."""
    return F.broadcast(df) if rows_within(df, limit) else df


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, share: int = 1000) -> DataFrame:
    """Inner join with a saved table of distinct keys, in which count tells how many rows left has of each.

    A small table is broadcast whole. Of a larger one the keys that have more than a share-th of left's rows, so
    fewer than share of them, are broadcast, and the others meet by a shuffle, in which no key is hot.
    """
    if rows_within(right):
        return left.join(F.broadcast(right), keys)
    limit = (right.agg(F.sum(count)).first()[0] or 0) // share
    hot = F.broadcast(right.where(F.col(count) > limit))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(count) <= limit), keys)
    return left.join(hot, keys).unionByName(rest)


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the smallest node that it reaches) of all nodes that aren't the smallest themselves."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    some = root != np.arange(len(nodes))
    return nodes[some], nodes[root[some]]


def _contract(batches):
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        u, v = _roots(*(np.concatenate([x, c.to_numpy()]) for x, c in zip((u, v), batch.columns, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


#: Edges that one task contracts.
EDGES_PER_TASK = 400_000


def components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component), component the smallest id.

    Each part of the edges, of a bounded number, is contracted to stars by itself. Where there are several parts,
    alternating large-star and small-star rounds follow until nothing changes: minima are aggregated by key and joined
    back, so that no node's neighbours are ever gathered. Each round is written to the shared folder. Nodes that
    are only linked with themselves, and nodes without edges, are absent. Empty input gives an empty table.
    """
    e = work.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), f"{name}-edges")
    parts = -(-e.count() // EDGES_PER_TASK) or 1
    e = e.coalesce(1) if parts == 1 else e.repartition(parts, F.xxhash64("u", "v"))
    e = work.save(e.mapInArrow(_contract, "u long, v long"), f"{name}-0")
    work.drop(f"{name}-edges")
    before, step = None, 0
    while parts > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), f"{name}-{step}-a")
        large = work.save(join_counted(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-{step}-b")
        least = work.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-{step}-c")
        # each node keeps its smallest neighbour, and its other neighbours are handed over to that one
        step_edges = join_counted(large, least, ["u"], "n").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = work.save(step_edges.select("x.u", "x.v").where("u <> v").distinct(), f"{name}-{step + 1}")
        work.drop(f"{name}-{step}", *(f"{name}-{step}-{x}" for x in "abc"))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, step = now, step + 1
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

"""A versioned store: Parquet tables per version, and a pointer that names the current one.

A change writes new tables beside the old ones and then moves the pointer, so chunks, postings and edges change
together. One writer at a time; the version before stays for readers that still hold it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import delta, graph
from quarry.operators.keyword import postings
from quarry.schemas import CHUNKS, EDGES, POSTINGS, SCHEMA_VERSION

TABLES = {"chunks": CHUNKS, "postings": POSTINGS, "edges": EDGES}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        return max((n.removeprefix("_current-") for n in names if n.startswith("_current-")), default=None)

    def ensure(self) -> None:
        """Create empty tables where there are none; running it again changes nothing."""
        if self.version() is None:
            self.publish(**{n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})

    def schema_version(self) -> int:
        return SCHEMA_VERSION if self.version() else 0

    def read(self, name: str) -> DataFrame:
        """A table of the current version, columns by name; those it lacks are null."""
        found = self.spark.read.parquet(f"{self.root}/{self.version()}/{name}")
        return found.select(*((F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]))

    def publish(self, **tables: DataFrame) -> str:
        """Write a version; tables that aren't given are copied. The pointer moves last, by a rename."""
        old = self.version()
        new = f"{int(old.split('-')[0]) + 1 if old else 1:012d}-{uuid.uuid4().hex[:8]}"
        for name in TABLES:
            df = tables[name] if name in tables else self.read(name)
            (df.sortWithinPartitions("Term") if name == "postings" else df).write.parquet(f"{self.root}/{new}/{name}")
        draft = self._path(f"{self.root}/.draft-{new}")
        self._fs.create(draft, True).close()
        self._fs.rename(draft, self._path(f"{self.root}/_current-{new}"))
        if old:
            self._fs.delete(self._path(f"{self.root}/_current-{old}"), False)
            for s in self._fs.listStatus(self._path(self.root)):
                name = s.getPath().getName()
                if s.isDirectory() and name not in (old, new):
                    self._fs.delete(s.getPath(), True)
        return new

    def upsert(self, new: DataFrame, replaced_files: DataFrame | None = None) -> None:
        """Chunks by Id, the last of a batch's duplicates; their postings and edges follow. new is evaluated once.

        replaced_files: (FilePath, Id) of all that these files now hold; what they held before and no longer do goes.
        """
        rows = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNKS)).withColumn("_seq", F.monotonically_increasing_id())
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"  # goes when the version is published
        rows.write.parquet(staged)
        rows = delta.last_wins(self.spark.read.schema(rows.schema).parquet(staged), "_seq").drop("_seq")
        chunks = delta.upsert(self.read("chunks"), rows)
        if replaced_files is not None:
            held = replaced_files.select("FilePath").distinct()
            gone = chunks.join(held, "FilePath", "left_semi").join(replaced_files.select("Id"), "Id", "left_anti").select("Id")
            chunks = chunks.join(gone, "Id", "left_anti")
        self._with_chunks(chunks, rows)

    def _with_chunks(self, chunks: DataFrame, changed: DataFrame | None = None) -> None:
        ids = chunks.select(F.col("Id").alias("ChunkId"))
        kept = self.read("postings").join(ids, "ChunkId", "left_semi")
        if changed is not None:
            kept = kept.join(changed.select(F.col("Id").alias("ChunkId")), "ChunkId", "left_anti").unionByName(postings(changed))
        names = [f.name for f in EDGES]
        resolved = lambda rows: graph.resolve_calls(rows.where("CallsTo IS NOT NULL")).select(*names)
        # edges that were added stay as long as both ends do
        added = graph.live_edges(self.read("edges").subtract(resolved(self.read("chunks"))), chunks)
        self.publish(chunks=chunks, postings=kept, edges=resolved(chunks).unionByName(added).distinct())

    def delete_file(self, path: str) -> int:
        """Remove a file's chunks; returns how many there were."""
        return self.delete_files([path])

    def delete_files(self, paths: list[str]) -> int:
        """Remove the chunks of some files in one version; returns how many there were."""
        gone = F.col("FilePath").isin([p for p in paths if p.strip()])
        n = self.read("chunks").where(gone).count()
        if n:
            self._with_chunks(self.read("chunks").where(~gone))
        return n

    def delete_missing(self, present: DataFrame, root: str = "") -> int:
        """Remove chunks of files below root that aren't listed; returns how many files."""
        below = F.startswith(F.col("FilePath"), F.lit(root.rstrip("/") + "/")) if root else F.lit(True)
        gone = self.read("chunks").where(below).select("FilePath").distinct().join(present.select("FilePath"), "FilePath", "left_anti")
        n = gone.count()
        if n:
            self._with_chunks(self.read("chunks").join(gone, "FilePath", "left_anti"))
        return n

    def add_edges(self, edges: DataFrame) -> None:
        self.publish(edges=self.read("edges").unionByName(edges).distinct())

    def clear(self, *names: str) -> None:
        self.publish(**{n: self.spark.createDataFrame([], TABLES[n]) for n in names or TABLES})

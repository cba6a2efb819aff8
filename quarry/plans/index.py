"""Incremental indexing: files to chunks, changed ones embedded and published."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import delta
from quarry.schemas import ChunkingOptions
from quarry.sources import files
from quarry.sources.store import Store

OK, ERROR, NOTHING = 0, 1, 2


def index_chunks(store: Store, new: DataFrame, make: Callable[[], files.Embedder]) -> int:
    """Upsert what changed of the chunks of some files, and drop what these files no longer hold; returns how many changed."""
    held = new.select("FilePath", "Id")
    changed = delta.changed(new, store.read("chunks").select("Id", "ContentHash"))
    n = changed.count()
    gone = store.read("chunks").join(held.select("FilePath").distinct(), "FilePath", "left_semi").join(held, "Id", "left_anti")
    if n or gone.head(1):
        store.upsert(files.embed(changed, make), held)
    return n


def index(store: Store, directory: str, make: Callable[[], files.Embedder] = files.HashingEmbedder, options: ChunkingOptions = ChunkingOptions(), exclude: bool = False) -> int:
    """Index all *.cs files below a directory; exit code 0, 1 without the directory, or 2 if nothing was found."""
    spark = store.spark
    if "://" not in directory and not os.path.isdir(directory):
        return ERROR
    store.ensure()
    present = files.listing(spark, directory)
    store.delete_missing(present, directory if "://" in directory else os.path.abspath(directory))
    new = files.members(files.read_sources(spark, directory, exclude=exclude), options)
    if not new.head(1):
        return NOTHING
    index_chunks(store, new, make)
    return OK


def index_files(store: Store, paths: list[str], make: Callable[[], files.Embedder] = files.HashingEmbedder, options: ChunkingOptions = ChunkingOptions()) -> None:
    """Index some files again; files that are gone or hold nothing lose their chunks."""
    there = [p for p in paths if os.path.exists(p)]
    new = files.members(files.read_sources(store.spark, there), options) if there else None
    filled = {r.FilePath for r in new.select("FilePath").distinct().collect()} if new is not None else set()
    store.delete_files([p for p in paths if p not in filled])
    if filled:
        index_chunks(store, new.where(F.col("FilePath").isin(sorted(filled))), make)

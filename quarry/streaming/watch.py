"""Live re-indexing: a stream of file changes, each released after a quiet period, applied batch by batch."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quarry.plans import index as indexing
from quarry.sources.files import EXCLUDED, Embedder, HashingEmbedder
from quarry.sources.store import Store

QUIET_SECONDS = 0.5


def snapshot(directory: str) -> dict[str, tuple[float, int]]:
    """(modified, size) of each watched file."""
    out = {}
    for top, names, found in os.walk(directory):
        names[:] = [n for n in names if n.lower() not in EXCLUDED]
        for name in found:
            if name.endswith(".cs"):
                path = os.path.join(top, name)
                try:
                    s = os.stat(path)
                except OSError:
                    continue
                out[path] = (s.st_mtime, s.st_size)
    return out


def changes(before: dict[str, tuple[float, int]], now: dict[str, tuple[float, int]], clock: float) -> list[tuple[str, str]]:
    """Deletes at once; new and edited files once they have been quiet. before takes over what is released."""
    out = [(p, "delete") for p in sorted(before) if p not in now]
    for p, _ in out:
        del before[p]
    for p, state in sorted(now.items()):
        if before.get(p) != state and clock - state[0] >= QUIET_SECONDS:
            before[p] = state
            out.append((p, "upsert"))
    return out


class ChangeReader(SimpleDataSourceStreamReader):
    """Offsets count entries of a change log beside the checkpoint, so that a batch can be read again."""

    def __init__(self, directory: str, log: str):
        self.directory, self.log, self.seen = directory, log, None

    def _entries(self) -> list:
        return [json.loads(x) for x in open(self.log, encoding="utf-8")] if os.path.exists(self.log) else []

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        entries = self._entries()
        if self.seen is None:  # what earlier runs released
            self.seen = {}
            for path, op, state in entries:
                self.seen.pop(path, None)
                if op == "upsert":
                    self.seen[path] = tuple(state)
        with open(self.log, "a", encoding="utf-8") as f:
            for path, op in changes(self.seen, snapshot(self.directory), time.time()):
                entries.append([path, op, self.seen.get(path)])
                f.write(json.dumps(entries[-1]) + "\n")
        new = entries[start["n"] :]
        return iter([(p, op) for p, op, _ in new]), {"n": len(entries)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(p, op) for p, op, _ in self._entries()[start["n"] : end["n"]]])

    def commit(self, end: dict) -> None:
        pass


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_changes"

    def schema(self) -> str:
        return "path string, op string"

    def simpleStreamReader(self, schema):
        return ChangeReader(self.options["path"], self.options["log"])


def apply(store: Store, batch: DataFrame, make: Callable[[], Embedder]) -> None:
    """Deletes first, then upserts; a batch's paths are few."""
    last = {r.path: r.op for r in batch.collect()}
    store.delete_files(sorted(p for p, op in last.items() if op == "delete"))
    again = sorted(p for p, op in last.items() if op == "upsert")
    if again:
        indexing.index_files(store, again, make)


def start(store: Store, directory: str, state: str, make: Callable[[], Embedder] = HashingEmbedder, interval: str = "500 milliseconds", once: bool = False):
    """Start the stream; state is a folder for its checkpoint and change log."""
    os.makedirs(state, exist_ok=True)
    store.spark.dataSource.register(ChangeSource)
    stream = store.spark.readStream.format("quarry_changes").option("path", directory).option("log", f"{state}/changes.jsonl").load()
    writer = stream.writeStream.option("checkpointLocation", f"{state}/checkpoint").foreachBatch(lambda df, _: apply(store, df, make))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def watch(store: Store, directory: str, make: Callable[[], Embedder] = HashingEmbedder) -> int:
    """Index the directory, then follow its changes until interrupted."""
    if indexing.index(store, directory, make) == indexing.ERROR:
        return indexing.ERROR
    query = start(store, directory, f"{store.root}-watch", make)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
    return 0

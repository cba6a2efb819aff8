"""Command line: --mode index, search, watch or mcp."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quarry.plans import index as indexing
from quarry.plans.search import as_json, as_quiet, as_text, search
from quarry.plans.server import Server
from quarry.schemas import SearchFilter, SearchOptions
from quarry.sources.files import HashingEmbedder
from quarry.sources.store import Store
from quarry.streaming.watch import watch


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("-m", "--mode", required=True, choices=["index", "search", "watch", "mcp"])
    p.add_argument("--store", default="./quarry-index")
    p.add_argument("-p", "--path")
    p.add_argument("-q", "--query")
    p.add_argument("-f", "--format", type=str.lower, choices=["text", "json", "quiet"])
    p.add_argument("--quiet", action="store_true")
    p.add_argument("-l", "--limit")
    for name in ("namespace", "class", "http-method", "file-pattern"):
        p.add_argument(f"--{name}")
    try:
        a = p.parse_args(argv)
    except SystemExit:
        return 1
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    store = Store(spark, a.store)
    if a.mode == "index":
        return indexing.index(store, a.path or ".")
    if a.mode != "watch" and store.version() is None:
        print(f"There is no index in {a.store}; run --mode index first.", file=sys.stderr)
        return 1
    store.ensure()
    if a.mode == "watch":
        return watch(store, a.path or ".")
    limit = int(a.limit) if (a.limit or "").isdecimal() else 0  # what is no number counts as none given
    options = SearchOptions(display_count=limit) if limit > 0 else SearchOptions()
    if a.mode == "mcp":
        Server(store, HashingEmbedder()).serve(sys.stdin, out)
        return 0
    where = SearchFilter(a.namespace, getattr(a, "class"), a.http_method, a.file_pattern)
    show = {"json": as_json, "quiet": as_quiet, "text": as_text}[a.format or ("quiet" if a.quiet else "text")]
    for query in [a.query] if a.query else iter(lambda: input("> ").strip(), ""):
        if query == "quit":
            break
        found = search(store, query, HashingEmbedder(), options, where)
        if text := show(found):
            print(text, file=out)
        if a.query and not found.results:
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

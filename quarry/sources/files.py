"""Source files, their members, and embeddings, as frames."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.schemas import CHUNKS, ChunkingOptions
from quarry.sources import csharp

#: Directories that are not watched.
EXCLUDED = ["bin", "obj", ".git", ".vs", ".idea", "node_modules", ".next", "dist", "build"]
RAW = "FilePath string, NamespaceName string, ClassName string, MemberName string, MemberType string, Signature string, Documentation string, ClassDocumentation string, Body string, StartLine int, EndLine int, IsController boolean, IsService boolean, IsMiddleware boolean, BoostController boolean, BoostService boolean, BoostMiddleware boolean, HttpMethods string, RouteTemplate string, CallsTo array<string>, ChunkIndex int, TotalChunks int"


def listing(spark: SparkSession, directory: str, pattern: str = "*.cs") -> DataFrame:
    """FilePath, modified, length of all matching files below a directory; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
    return found.select(_path("path").alias("FilePath"), F.col("modificationTime").alias("modified"), "length")


def _path(column: str):
    return F.regexp_replace(column, "^file:/+", "/")


def is_excluded(path):
    """Whether a path has an excluded directory."""
    return F.arrays_overlap(F.split(F.lower(path), r"[\\/]"), F.array(*map(F.lit, EXCLUDED)))


def read_sources(spark: SparkSession, paths: str | list[str], pattern: str = "*.cs", exclude: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    found = reader.load(paths).select(_path("path").alias("FilePath"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\uFEFF", "").alias("text"))
    return found.where(~is_excluded(F.col("FilePath"))) if exclude else found


def members(sources: DataFrame, options: ChunkingOptions = ChunkingOptions()) -> DataFrame:
    """The chunks of (FilePath, text), with final ids and hashes, parents and boosted contents. A file that fails is skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RAW.split(", ")]
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(batch["FilePath"], batch["text"], strict=True):
                try:
                    rows += csharp.chunks(path, text or "", options)
                except (ValueError, IndexError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=columns)

    raw = sources.select("FilePath", "text").mapInPandas(run, RAW)
    c = F.col
    content = X.build_content(c("ClassDocumentation"), c("Documentation"), c("Signature"), c("Body"))
    out = raw.withColumn("Content", X.boost_content(content, c("ClassName"), c("MemberName"), c("BoostController"), c("BoostService"), c("BoostMiddleware")))
    key = (c("FilePath"), c("NamespaceName"), c("ClassName"), c("MemberName"), c("MemberType"))
    out = out.withColumn("Id", X.semantic_id(*key, c("ChunkIndex"), c("Signature"))).withColumn("ContentHash", X.content_hash(c("Content")))
    out = out.withColumn("ParentChunkId", F.when(c("ChunkIndex") > 0, X.semantic_id(*key, F.lit(0), c("Signature")))).withColumn("IndexedAt", F.current_timestamp()).withColumn("Embedding", F.lit(None).cast("array<float>"))
    return out.select(*(c(f.name).cast(f.dataType).alias(f.name) for f in CHUNKS))


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic and offline: hashed terms in a vector of length 1."""

    def __init__(self, dimensions: int = 768):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in re.findall(r"[A-Za-z0-9]+", text or ""):
                for term in {word.lower(), *(p.lower() for p in re.split(r"(?<=[a-z])(?=[A-Z])", word))}:
                    h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                    v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else [])
        return out


class HttpEmbedder:
    """An embedding server: style 'ollama' or 'openai'. Batches keep their order; where a batch fails, texts go one by one."""

    def __init__(self, url: str, model: str, style: str = "ollama", timeout: float = 300.0, limit: int = 8192):
        self.url, self.model, self.style, self.timeout, self.limit = url.rstrip("/"), model, style, timeout, limit

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def one(self, text: str) -> list[float]:
        if not (text or "").strip():
            return []
        if self.style == "ollama":
            return self._post("/api/embeddings", {"model": self.model, "prompt": text[: self.limit]})["embedding"]
        return self._post("/v1/embeddings", {"model": self.model, "input": text})["data"][0]["embedding"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        try:
            if self.style == "ollama":
                got = self._post("/api/embed", {"model": self.model, "input": [t[: self.limit] for t in texts]})["embeddings"]
            else:
                got = [x["embedding"] for x in sorted(self._post("/v1/embeddings", {"model": self.model, "input": texts})["data"], key=lambda x: x["index"])]
        except OSError as e:
            if self.style == "ollama" and getattr(e, "code", None) != 404:
                raise
            return [self.one(t) for t in texts]
        if len(got) != len(texts):
            raise ValueError("the server gave another number of embeddings than texts")
        return got

    def models(self) -> list[str]:
        path, key, name = ("/api/tags", "models", "name") if self.style == "ollama" else ("/v1/models", "data", "id")
        with urllib.request.urlopen(self.url + path, timeout=10) as answer:
            return [m[name] for m in json.load(answer)[key]]


def pick_model(available: list[str], wanted: str | None) -> str | None:
    """The exact name, else the one with the same base name, else (nothing wanted) the first."""
    if not wanted:
        return available[0] if available else None
    base = wanted.split(":")[0]
    return next((m for m in available if m == wanted), next((m for m in available if m.split(":")[0] == base), None))


def choose(provider: str, ollama: HttpEmbedder, openai: HttpEmbedder) -> HttpEmbedder:
    """The first provider that answers and has a model, in the order the setting asks for."""
    order = [ollama, openai] if provider == "ollama" else [openai, ollama]
    for e in order:
        try:
            model = pick_model(e.models(), e.model)
        except OSError:
            continue
        if model:
            return HttpEmbedder(e.url, model, e.style, e.timeout, e.limit)
    raise RuntimeError("no embedding server answers: start LM Studio or Ollama and load an embedding model")


def embed(chunks: DataFrame, make: Callable[[], Embedder], batch: int = 32) -> DataFrame:
    """chunks with Embedding; blank contents and empty vectors are left out. make() runs once a partition."""
    schema = chunks.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                part["Embedding"] = pd.Series([list(map(float, v)) for v in own.embed(part["Content"].tolist())], index=part.index, dtype=object)
                yield part

    return chunks.where("Content IS NOT NULL AND NOT Content RLIKE '^\\\\s*$'").mapInPandas(run, schema).where(F.size("Embedding") > 0)

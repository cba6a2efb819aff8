"""Vector search, the hybrid merge, filters and ranking."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import vector
from quarry.schemas import HybridOptions, RankerOptions, SearchFilter


def embedded(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("Embedding").isNotNull() & (F.size("Embedding") > 0))


def cosine_scores(chunks: DataFrame, query: Column) -> DataFrame:
    """Id, semantic of every chunk with a vector."""
    return embedded(chunks).select("Id", F.round(vector.cosine(F.col("Embedding"), query), 9).alias("semantic"))


def best(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("semantic"), "Id").limit(k)


def cosine_topk(chunks: DataFrame, query: Column, k: int) -> DataFrame:
    """Id, semantic of the k most similar chunks. Only ids and vectors are scanned; payloads join later."""
    return best(cosine_scores(chunks, query), k)


def predicate(f: SearchFilter) -> Column:
    """All set fields of a filter; blank ones hold."""
    def has(column: str, value: str) -> Column:
        return F.lower(column).contains(value.lower())

    found: list[Column] = []
    for column, value in (("NamespaceName", f.namespace), ("ClassName", f.class_name), ("HttpMethods", f.http_method)):
        if value and value.strip():
            found.append(has(column, value))
    if f.file_pattern and f.file_pattern.strip():  # wildcards are dropped, the rest must occur
        found.append(has("FilePath", f.file_pattern.replace("*", "").replace("?", "")))
    if f.chunk_type and f.chunk_type.strip():
        found.append(F.lower("MemberType") == f.chunk_type.lower())
    for column, flag in (("IsController", f.is_controller), ("IsService", f.is_service), ("IsMiddleware", f.is_middleware)):
        if flag is not None:
            found.append(F.col(column) == F.lit(flag))
    return reduce(and_, found, F.lit(True))


def combine(semantic: DataFrame, keyword: DataFrame, options: HybridOptions = HybridOptions()) -> DataFrame:
    """Id, semantic, keyword, hybrid; a side that misses counts 0."""
    both = semantic.join(keyword, "Id", "full_outer").select("Id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"))
    return both.withColumn("hybrid", F.col("semantic") * options.semantic_weight + F.col("keyword") * options.keyword_weight)


def boost(terms: list[str], o: RankerOptions = RankerOptions()) -> Column:
    """The product of structural boosts of a chunk."""
    names = reduce(lambda a, b: a | b, (F.lower(c).contains(t) for t in terms for c in ("ClassName", "MemberName")), F.lit(False))
    size = F.length("Content")

    def when(condition: Column, factor: float) -> Column:
        return F.when(condition, F.lit(factor)).otherwise(F.lit(1.0))

    return (
        when(names, o.name_boost) * when(F.col("IsController"), o.controller_boost) * when(F.col("IsService"), o.service_boost) * when(F.col("IsMiddleware"), o.middleware_boost)
        * when(~F.coalesce("Documentation", F.lit("")).rlike(r"^\s*$"), o.documented_boost) * when(F.col("EndLine") - F.col("StartLine") + 1 <= o.short_lines, o.short_penalty)
        * F.when(size > 0, F.greatest(F.lit(0.8), F.least(F.lit(1.0), F.lit(500.0) / size))).otherwise(F.lit(1.0))
    )


def rank(candidates: DataFrame, terms: list[str], k: int, options: RankerOptions = RankerOptions()) -> DataFrame:
    """The k best by final score: hybrid score times boosts."""
    scored = candidates.withColumn("final", F.round(F.col("hybrid") * boost(terms, options), 9))
    return scored.orderBy(F.desc("final"), "Id").limit(k)


def payload(scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scores (few rows, limited before) joined with their chunks."""
    return chunks.join(F.broadcast(scores), "Id")

"""Ranked search over a store, and the forms its results are shown in."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vector
from quarry.operators import hybrid, keyword, suggest, threshold
from quarry.schemas import SearchFilter, SearchOptions
from quarry.sources.files import Embedder
from quarry.sources.store import Store


@dataclass
class SearchResult:
    query: str
    expanded_query: str
    effective_threshold: float
    results: list
    suggestions: list[str]


def terms_of(spark, query: str, ranker: bool = False) -> list[str]:
    function = X.ranker_terms if ranker else X.tokenize
    return spark.range(1).select(function(F.lit(query)).alias("t")).first().t


def search(store: Store, query: str, embedder: Embedder, options: SearchOptions = SearchOptions(), where: SearchFilter | None = None, synonyms: dict[str, list[str]] | None = None) -> SearchResult:
    """Expand, embed, retrieve by vector and keyword, merge, filter, rank and cut. One job for the candidates."""
    where = where or SearchFilter()
    o = replace(options, top_k=max(options.top_k, 50)) if not where.empty else options
    expanded = suggest.expand(query, synonyms)
    vectors = embedder.embed([expanded])
    if not vectors or not vectors[0]:
        raise ValueError("the query's embedding is empty")
    chunks = store.read("chunks")
    pool = chunks.where(hybrid.predicate(where)) if o.prefilter else chunks
    semantic = hybrid.cosine_topk(pool, vector.literal(vectors[0]), 2 * o.top_k)
    if o.use_keyword:
        top = keyword.keyword_topk(store.read("postings"), pool, terms_of(store.spark, expanded), 2 * o.top_k)
        merged = hybrid.combine(semantic, keyword.keyword_scores(top), o.hybrid)
    else:
        merged = semantic.select("Id", "semantic", F.lit(0.0).alias("keyword"), F.col("semantic").alias("hybrid"))
    found = hybrid.payload(merged, chunks.drop("Embedding")).where(hybrid.predicate(where))
    rows = hybrid.rank(found, terms_of(store.spark, expanded, True), o.top_k, o.ranker).orderBy(F.desc("final"), "Id").collect()  # at most top_k
    limit = max(o.minimum_similarity, threshold.adaptive([r.hybrid for r in rows], query, o.threshold))
    shown = [r for r in rows if r.hybrid >= limit][: o.display_count]
    near: list[str] = []
    if not shown and rows and max(r.hybrid for r in rows) >= o.weak_match_threshold and where.empty:
        near = [r.term for r in suggest.suggest(chunks, query).collect()]
    return SearchResult(query, expanded, limit, shown, near)


def _short(text: str, limit: int) -> str:
    return text[:limit] + "..." if len(text) > limit else text


def as_text(result: SearchResult) -> str:
    out = [f"Query: {result.query}", f"Expanded: {result.expanded_query}", f"Threshold: {result.effective_threshold:.4f}"]
    if not result.results:
        out.append("No results found." + (f" Did you mean: {', '.join(result.suggestions)}?" if result.suggestions else ""))
    for i, r in enumerate(result.results, 1):
        out += [f"{i}. {r.NamespaceName}.{r.ClassName}.{r.MemberName}", f"   Score: {r.hybrid:.4f} (semantic={r.semantic:.4f}, keyword={r.keyword:.4f})", f"   Type: {r.MemberType}", f"   File: {r.FilePath} (lines {r.StartLine}-{r.EndLine})", "   Signature: " + r.Signature.split("\n")[0]]
        if (r.Documentation or "").strip():
            out.append("   Documentation: " + _short(r.Documentation.replace("\n", " ").replace("///", "").strip(), 100))
        out += ["   Content Preview:", "   " + _short(r.Content.replace("\n", " ").replace("\r", ""), 200)]
    return "\n".join(out)


FIELDS = {"memberName": "MemberName", "className": "ClassName", "namespaceName": "NamespaceName", "memberType": "MemberType", "filePath": "FilePath", "startLine": "StartLine", "endLine": "EndLine", "signature": "Signature", "content": "Content", "score": "hybrid", "semanticScore": "semantic", "keywordScore": "keyword"}


def as_dict(result: SearchResult) -> dict:
    return {"query": result.query, "expandedQuery": result.expanded_query, "effectiveThreshold": result.effective_threshold, "resultCount": len(result.results), "suggestions": result.suggestions, "results": [{k: r[v] for k, v in FIELDS.items()} for r in result.results]}


def as_json(result: SearchResult) -> str:
    return json.dumps(as_dict(result), indent=2, ensure_ascii=False)


def as_quiet(result: SearchResult) -> str:
    return "".join(f"{r.MemberName} — {r.FilePath}:{r.StartLine} (score: {r.hybrid:.3f})" for r in result.results[:1])

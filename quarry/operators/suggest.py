"""Spelling suggestions and query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X

#: Default synonyms.
SYNONYMS = {
    "db": ["database", "sql", "entity framework"],
    "http": ["web", "api", "rest", "endpoint"],
    "async": ["asynchronous", "task", "background"],
    "sensor": ["ultrasonic", "distance", "color", "gyro"],
    "file": ["io", "read", "write", "stream"],
}


def names(chunks: DataFrame) -> DataFrame:
    """Distinct non-blank class, member and namespace names."""
    return chunks.select(F.explode(F.array("ClassName", "MemberName", "NamespaceName")).alias("term")).where("term IS NOT NULL AND NOT term RLIKE '^\\\\s*$'").distinct()


def distance(query: str, term: Column) -> Column:
    """The least edit distance of the query to the name or to one of its camel pieces, case ignored."""
    every = F.concat(F.array(F.lower(F.trim(term))), X.camel_boundary(F.trim(term)))
    return F.array_min(F.transform(every, lambda p: F.levenshtein(p, F.lit(query.lower()))))


def suggest(chunks: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """term, dist, len_diff of the nearest names; the query itself is none."""
    if not query.strip():
        return names(chunks).select("term", F.lit(0).alias("dist"), F.lit(0).alias("len_diff")).where(F.lit(False))
    near = names(chunks).where(F.lower("term") != query.lower()).select("term", distance(query, F.col("term")).alias("dist"), F.abs(F.length("term") - len(query)).alias("len_diff"))
    return near.where(F.col("dist") <= max(2, len(query) // 3)).orderBy("dist", "len_diff", "term").limit(limit)


def synonyms(config: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Defaults, replaced key by key by configured comma-separated lists; blank ones are ignored."""
    table = dict(SYNONYMS)
    for key, value in (config or {}).items():
        words = [w.strip() for w in value.split(",") if w.strip()]
        if words:
            table[key.lower()] = words
    return table


def expand(query: str, table: dict[str, list[str]] | None = None) -> str:
    """The lower-case words, then their synonyms, each once. A blank query stays as it is."""
    table = SYNONYMS if table is None else table
    if not query.strip():
        return query
    words = [w for w in query.lower().split(" ") if w]
    return " ".join(dict.fromkeys([*words, *(s for w in words for s in table.get(w, []))]))


def expand_column(query: Column, table: dict[str, list[str]] | None = None) -> Column:
    table = SYNONYMS if table is None else table
    lookup = F.create_map(*(x for k, v in sorted(table.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))))
    words = F.filter(F.split(F.lower(query), " "), lambda w: w != "")
    more = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(lookup, w), F.array().cast("array<string>"))))
    return F.when(F.trim(query) == "", query).otherwise(F.array_join(F.array_distinct(F.concat(words, more)), " "))

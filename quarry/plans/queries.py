"""Every operator as a query over the driver's tables, with the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vector as V
from quarry.operators import delta, graph, hybrid, keyword, suggest, threshold
from quarry.schemas import SearchFilter
from quarry.sources import files
from quarry.streaming import debounce

CHUNKS = """
SELECT CAST(d.doc_id AS STRING) AS Id,
       concat('/', d.source, '/', d.lang, '/doc', CAST(d.doc_id AS STRING), '.cs') AS FilePath,
       concat(d.source, '.', d.lang) AS NamespaceName,
       concat('Doc', CAST(d.doc_id % 50 AS STRING), 'Service') AS ClassName,
       concat('Get', upper(d.lang), CAST(d.doc_id % 7 AS STRING)) AS MemberName,
       CASE d.doc_id % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'Property' WHEN 2 THEN 'Constructor' ELSE 'Field' END AS MemberType,
       d.text AS Content, substr(d.text, 1, 60) AS Signature,
       CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE substr(d.text, 1, 120) END AS Documentation,
       CAST(1 AS INT) AS StartLine, CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS INT) AS EndLine,
       e.embedding AS Embedding,
       d.doc_id % 5 = 0 AS IsController, d.doc_id % 7 = 0 AS IsService, d.doc_id % 11 = 0 AS IsMiddleware,
       CASE d.doc_id % 6 WHEN 0 THEN 'Get' WHEN 1 THEN 'Post' WHEN 2 THEN 'Get, Post' ELSE NULL END AS HttpMethods
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
"""
#: The chunks without their vectors, and so without a join.
TEXTS = CHUNKS.replace("       e.embedding AS Embedding,\n", "").replace(" LEFT JOIN embeddings e ON d.doc_id = e.vec_id", "")
EDGES = """
SELECT DISTINCT CAST(l_suppkey AS STRING) AS SourceChunkId, CAST(l_partkey % 100 + 1 AS STRING) AS TargetChunkId,
       'Invocation' AS CallType, CAST(l_linenumber AS INT) AS LineNumber
FROM lineitem 
"""
TERMS = ["the", "and", "service", "doc7", "geten"]
QUERY = "the and service doc7 geten"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, CHUNKS, "documents", "embeddings")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """One row per document, for what looks at texts and ids only: a join would shuffle every text."""
    return _sql(spark, d, TEXTS, "documents")


def _sql(spark: SparkSession, d: str, text: str, *names: str) -> DataFrame:
    """SQL over tables of this directory, without temporary views."""
    frames = {n: _table(spark, d, n) for n in names}
    for n in names:
        text = text.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(text, **frames)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, EDGES, "lineitem")


def dealt(df: DataFrame, d: str) -> DataFrame:
    """The driver's tables are one partition each at small scale; text work is dealt out.

    Partitions are counted on the table: to count those of a join, Spark runs it.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if _table(spark, d, "documents").rdd.getNumPartitions() < 2 else df


def query_vector(spark: SparkSession, d: str):
    return V.literal(_table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _kw(s: SparkSession, d: str, k: int = 40) -> DataFrame:
    c = texts(s, d)
    return keyword.keyword_topk(keyword.postings(dealt(c, d)), c, TERMS, k)


def _summed(s: SparkSession, d: str) -> DataFrame:
    """Postings summed by chunk and term. A first job, over ids only, tells if any occurs twice: if none does, no term is shuffled."""
    c = texts(s, d)
    distinct = c.groupBy("Id").count().where("count > 1").isEmpty()
    return keyword.summed(dealt(c, d), distinct).select("ChunkId", "Term", F.round("Weight", 6).alias("weight"))


def _cosine(s: SparkSession, d: str, k: int) -> DataFrame:
    """The k most similar chunks. Vectors are scored before the join, so that only ids and scores are shuffled."""
    vectors = _table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("Id"), F.col("embedding").alias("Embedding"))
    known = _table(s, d, "documents").select(F.col("doc_id").cast("string").alias("Id"))
    return hybrid.best(hybrid.cosine_scores(vectors, query_vector(s, d)).join(known, "Id"), k)


def _merged(s: SparkSession, d: str) -> DataFrame:
    return hybrid.combine(_cosine(s, d, 40), keyword.keyword_scores(_kw(s, d)))


def _payload(s: SparkSession, d: str, scores: DataFrame) -> DataFrame:
    """Scores with their chunks, vectors aside. The embeddings join the few rows found: of an id with two vectors there are two chunks."""
    found = hybrid.payload(scores, texts(s, d))
    vectors = _table(s, d, "embeddings").select("vec_id")
    return found.join(vectors, F.col("Id").cast("long") == F.col("vec_id"), "left").drop("vec_id")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return _payload(s, d, _merged(s, d))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return hybrid.rank(_candidates(s, d), TERMS, 20)


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _filter(f: SearchFilter):
    return lambda s, d: chunks(s, d).where(hybrid.predicate(f)).select("Id")


def _exploded(function, column: str):
    return lambda s, d: dealt(texts(s, d), d).select("Id", F.posexplode(function(F.col(column))).alias("pos", "term"))


def _stored(s: SparkSession, d: str) -> DataFrame:
    """What the store is taken to hold: even documents, every tenth with another hash."""
    hashed = chunks(s, d).select("Id", "FilePath", X.content_hash(F.col("Content")).alias("ContentHash"))
    return hashed.where("CAST(Id AS INT) % 2 = 0").withColumn("ContentHash", F.when(F.expr("CAST(Id AS INT) % 10 = 0"), F.lit("old")).otherwise(F.col("ContentHash")))


def _hashed(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).select("Id", "FilePath", X.content_hash(F.col("Content")).alias("ContentHash"))


def _calls(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d)
    call = F.when(F.expr("CAST(Id AS INT) % 2 = 0"), F.concat(F.lit("src1.en.Doc1Service.Get"), F.upper(F.substring_index("NamespaceName", ".", -1)), F.lit("1"))).otherwise(F.concat(F.lit("x."), "MemberName"))
    return c.select("Id", "NamespaceName", "ClassName", "MemberName", F.array(call).alias("CallsTo"))


def _effective(s: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(s, d)
    limit = threshold.adaptive_frame(ranked, "hybrid", QUERY).select(F.greatest(F.lit(0.3), "threshold").alias("effective"))
    return ranked.join(F.broadcast(limit), F.col("hybrid") >= F.col("effective")).orderBy(F.desc("final"), "Id").limit(5)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return suggest.names(chunks(s, d)).select("term", suggest.distance("Doc7Servce", F.col("term")).cast("long").alias("dist"))


def _gate(s: SparkSession, d: str) -> DataFrame:
    return _ranked(s, d).agg(F.round(F.max("hybrid"), 6).alias("best"), (F.max("hybrid") >= 0.30).alias("suggests"))


def _sources(s: SparkSession, d: str) -> DataFrame:
    """A source file for each document: a class with a field, a property and a method."""
    code = "namespace %s\n{\n    public class %s\n    {\n        private int _count;\n        public string Title { get; set; }\n        public string %s(int id)\n        {\n            return Load(id);\n        }\n    }\n}\n"
    return dealt(chunks(s, d).select("FilePath", F.format_string(code, "NamespaceName", "ClassName", "MemberName").alias("text")), d)


def _members(s: SparkSession, d: str) -> DataFrame:
    found = files.members(_sources(s, d))
    return found.select("FilePath", "NamespaceName", "ClassName", "MemberName", "MemberType", "Signature", "StartLine", "EndLine", "IsService", F.array_join("CallsTo", ",").alias("calls"))


def _embedded(s: SparkSession, d: str) -> DataFrame:
    found = dealt(chunks(s, d).select("Id", "Content", "Embedding"), d)
    norm = F.sqrt(F.aggregate("Embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return files.embed(found, files.HashingEmbedder).select("Id", F.size("Embedding").cast("long").alias("dim"), F.round(norm, 4).alias("norm"))


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The table read as a stream: runs of a user's events that 30 minutes of silence followed."""
    events = s.readStream.schema(_table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")
    return debounce.drain(debounce.debounced(events, "user_id", "ts", "30 minutes"), debounce.work_folder(s))


_JSON = {"memberName": "MemberName", "className": "ClassName", "namespaceName": "NamespaceName", "memberType": "MemberType", "filePath": "FilePath", "startLine": "StartLine", "endLine": "EndLine", "signature": "Signature"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    doc = {
        "chunk_scan": lambda s, d: chunks(s, d).drop("Embedding"),
        "content_hash_map": lambda s, d: _hashed(s, d).select("Id", "ContentHash"),
        "content_hash": lambda s, d: chunks(s, d).select("Id", X.content_hash(F.col("Content")).alias("hash")),
        "embedded_scan": lambda s, d: hybrid.embedded(chunks(s, d)).select("Id", F.size("Embedding").cast("long").alias("dim")),
        "distinct_files": lambda s, d: chunks(s, d).select("FilePath").distinct(),
        "chunks_per_file": lambda s, d: chunks(s, d).groupBy("NamespaceName").agg(F.count("*").alias("n")),
        "point_lookup": lambda s, d: chunks(s, d).where("Id = '7'").select("Id", "FilePath", "MemberName").limit(1),
        "filter_namespace": _filter(SearchFilter(namespace="SRC1")),
        "filter_class": _filter(SearchFilter(class_name="doc7")),
        "filter_http_method": _filter(SearchFilter(http_method="POST")),
        "filter_file_pattern": _filter(SearchFilter(file_pattern="*/en/*")),
        "filter_chunk_type": _filter(SearchFilter(chunk_type="method")),
        "filter_flags": _filter(SearchFilter(is_controller=True, is_middleware=False)),
        "filter_combined": _filter(SearchFilter(namespace="en", http_method="get", is_service=False, class_name=" ")),
        "semantic_id": lambda s, d: chunks(s, d).select("Id", X.semantic_id(F.col("FilePath"), F.col("NamespaceName"), F.col("ClassName"), F.col("MemberName"), F.col("MemberType"), F.lit(0), F.col("Signature")).alias("sid")),
        "tokenize_terms": _exploded(X.tokenize, "Content"),
        "ranker_terms": _exploded(X.ranker_terms, "Content"),
        "identifier_parts": _exploded(X.identifier_parts, "Content"),
        "camel_split_all": lambda s, d: chunks(s, d).select("Id", F.array_join(X.camel_all(F.col("ClassName")), "|").alias("pieces")),
        "camel_split_boundary": lambda s, d: chunks(s, d).select("Id", F.array_join(X.camel_boundary(F.col("ClassName")), "|").alias("pieces")),
        "keyword_postings": _summed,
        "extract_terms": lambda s, d: keyword.postings(dealt(texts(s, d), d)),
        "keyword_topk": lambda s, d: r6(_kw(s, d), "raw"),
        "keyword_normalized": lambda s, d: r6(keyword.keyword_scores(_kw(s, d)), "keyword"),
        "cosine_topk": lambda s, d: r6(_cosine(s, d, 20), "semantic"),
        "cosine_topk_filtered": lambda s, d: r6(_payload(s, d, _cosine(s, d, 60)).where(hybrid.predicate(SearchFilter(namespace="en"))).orderBy(F.desc("semantic"), "Id").limit(20).select("Id", "semantic"), "semantic"),
        "cosine_truncated": lambda s, d: r6(hybrid.embedded(chunks(s, d)).select("Id", V.cosine(F.col("Embedding"), F.slice(query_vector(s, d), 1, 16)).alias("semantic")), "semantic"),
        "hybrid_combine": lambda s, d: r6(_merged(s, d), "semantic", "keyword", "hybrid"),
        "hybrid_filtered": lambda s, d: r6(_candidates(s, d).where(hybrid.predicate(SearchFilter(namespace="en"))).select("Id", "hybrid"), "hybrid"),
        "hybrid_ranked": lambda s, d: r6(_ranked(s, d).select("Id", "hybrid", "final"), "hybrid", "final"),
        "adaptive_threshold": lambda s, d: r6(threshold.adaptive_frame(_ranked(s, d), "hybrid", QUERY), "percentile", "gap", "threshold"),
        "effective_results": lambda s, d: r6(_effective(s, d).select("Id", "hybrid", "effective"), "hybrid", "effective"),
        "weak_match_gate": _gate,
        "levenshtein_pairs": _pairs,
        "suggest_top3": lambda s, d: suggest.suggest(chunks(s, d), "Doc7Servce").withColumns({"dist": F.col("dist").cast("long"), "len_diff": F.col("len_diff").cast("long")}),
        "query_expansion": lambda s, d: chunks(s, d).select("Id", suggest.expand_column(F.when(F.expr("CAST(Id AS INT) % 2 = 0"), F.concat(F.lit("db File "), "NamespaceName")).otherwise(F.lit("plain db"))).alias("expanded")),
        "changed_chunks": lambda s, d: delta.changed(_hashed(s, d), _stored(s, d)).select("Id"),
        "upsert_last_wins": lambda s, d: delta.upsert(_stored(s, d), delta.last_wins(_table(s, d, "events").select(F.expr("CAST(user_id % 400 AS STRING)").alias("Id"), F.lit("/e.cs").alias("FilePath"), F.expr("CAST(event_id AS STRING)").alias("ContentHash"), F.col("event_id").alias("seq")), "seq").drop("seq")),
        "delete_by_file": lambda s, d: delta.delete_file(chunks(s, d), "/src1/en/doc1.cs").select("Id"),
        "delete_missing_files": lambda s, d: delta.delete_missing(chunks(s, d), chunks(s, d).where("CAST(Id AS INT) % 3 <> 0").select("FilePath")).select("Id"),
        "orphan_edges": lambda s, d: graph.live_edges(edges(s, d), chunks(s, d).where("CAST(Id AS INT) % 4 <> 0")),
        "callers": lambda s, d: graph.callers(chunks(s, d), edges(s, d), "5").select("Id", "LineNumber"),
        "callees": lambda s, d: graph.callees(chunks(s, d), edges(s, d), "5").select("Id", "LineNumber"),
        "impact_radius": lambda s, d: graph.impact_radius(edges(s, d), "5", 2),
        "resolve_calls": lambda s, d: graph.resolve_calls(_calls(s, d)).select("SourceChunkId", "TargetChunkId"),
        "line_windows": lambda s, d: chunks(s, d).select("Id", F.explode(X.line_windows(F.col("Content"), 5, 2)).alias("w")).select("Id", "w.index", "w.start_line", "w.end_line", "w.content"),
        "needs_split": lambda s, d: chunks(s, d).select("Id", X.needs_split(F.col("Content"), 5).alias("splits")),
        "content_boost": lambda s, d: chunks(s, d).select("Id", X.boost_content(F.col("Signature"), F.col("ClassName"), F.col("MemberName"), F.col("IsController"), F.col("IsService"), F.col("IsMiddleware")).alias("boosted")),
        "build_content": lambda s, d: chunks(s, d).select("Id", X.build_content(F.col("Documentation"), F.col("Signature"), F.lit(" \n")).alias("built")),
        "debounce_events": lambda s, d: delta.debounce(_table(s, d, "events"), "user_id", "ts", "30 minutes"),
        "watch_stream": _stream,
        "parse_source_members": _members,
        "embed_batch": _embedded,
        "result_json": lambda s, d: _ranked(s, d).limit(5).select("Id", F.to_json(F.struct(*(F.col(v).alias(k) for k, v in _JSON.items()), F.round("hybrid", 6).alias("score"))).alias("json")),
        "result_quiet": lambda s, d: _ranked(s, d).limit(1).select(F.format_string("%s — %s:%d (score: %.3f)", "MemberName", "FilePath", "StartLine", "hybrid").alias("line")),
        "result_preview": lambda s, d: chunks(s, d).select("Id", X.preview(F.col("Documentation"), 100, True).alias("doc"), X.preview(F.col("Content"), 200).alias("content")),
    }
    return doc


def oracle_sql() -> dict[str, str]:
    c = CHUNKS.replace("STRING", "VARCHAR")
    base = f"WITH c AS ({c}), e AS ({EDGES.replace('STRING', 'VARCHAR')})"
    delim = X.char_class(X.INDEX_DELIMITERS).replace("'", "''")
    rdelim = X.char_class(X.RANK_DELIMITERS).replace("'", "''")
    idelim = X.char_class(X.IDENTIFIER_DELIMITERS).replace("'", "''")
    camel = "string_split(ltrim(regexp_replace(p, '(\\p{Lu})', chr(1) || '\\1', 'g'), chr(1)), chr(1))"
    edge = "string_split(regexp_replace(%s, '(\\p{Ll})(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"

    def keep(items: str) -> str:
        """Distinct values of a list, the first of each, in order."""
        return f"(SELECT list(t ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest({items}) AS t, generate_subscripts({items}, 1) AS i) GROUP BY t))"

    def toks(x: str) -> str:
        return f"list_transform(list_filter(flatten(list_transform(list_filter(regexp_split_to_array({x}, '{delim}'), lambda p: p <> ''), lambda p: list_append({camel}, p))), lambda p: length(p) >= 2), lambda p: lower(p))"

    def unfolded(items: str) -> str:
        return f"{base}, t AS (SELECT Id, {items} AS l FROM c), u AS (SELECT Id, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM t), f AS (SELECT Id, term, min(i) AS i FROM u GROUP BY Id, term) SELECT Id, CAST(row_number() OVER (PARTITION BY Id ORDER BY i) - 1 AS INTEGER) AS pos, term FROM f"

    idparts = f"list_transform(flatten(list_transform(list_filter(regexp_split_to_array(Content, '{idelim}'), lambda w: contains(w, '.') AND length(w) >= 3 AND len(list_filter(string_split(w, '.'), lambda s: length(s) >= 2)) >= 1), lambda w: list_append(list_filter(string_split(w, '.'), lambda s: length(s) >= 2), w))), lambda p: lower(p))"
    rterms = f"list_filter(list_transform(regexp_split_to_array(Content, '{rdelim}'), lambda p: lower(p)), lambda p: length(p) >= 2)"
    stem = "regexp_replace(list_extract(string_split(FilePath, '/'), -1), '\\.[^.]*$', '')"
    fields = [("ClassName", 1.0), ("MemberName", 0.8), ("Signature", 0.6), (stem, 0.4), ("NamespaceName", 0.4)]

    def first(name: str, items: str, limit: int) -> str:
        return f"{name} AS (SELECT Id, term FROM (SELECT Id, term, row_number() OVER (PARTITION BY Id ORDER BY min(i)) AS n FROM (SELECT Id, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM (SELECT Id, {items} AS l FROM c)) GROUP BY Id, term) WHERE n <= {limit})"

    named = " UNION ALL ".join(f"SELECT DISTINCT Id, unnest({toks(x)}) AS term, CAST({w} AS DOUBLE) AS w FROM c" for x, w in fields)
    post = f"{base}, named AS ({named}), {first('body', toks('Content'), 200)}, {first('parts', idparts, 100)}, " + """
    p AS (SELECT Id AS ChunkId, term AS Term, w AS Weight FROM named
      UNION ALL SELECT b.Id, b.term, CASE WHEN EXISTS (SELECT 1 FROM parts q WHERE q.Id = b.Id AND q.term = b.term) AND NOT EXISTS (SELECT 1 FROM named n WHERE n.Id = b.Id AND n.term = b.term) THEN 0.35 ELSE 0.3 END FROM body b
      UNION ALL SELECT q.Id, q.term, 0.35 FROM parts q WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.Id = q.Id AND n.term = q.term) AND NOT EXISTS (SELECT 1 FROM body b WHERE b.Id = q.Id AND b.term = q.term))"""
    terms = ", ".join(f"'{t}'" for t in TERMS)
    kw = post + f", kw AS (SELECT ChunkId AS Id, round(sum(Weight), 9) AS raw, count(DISTINCT Term) AS matched FROM p WHERE Term IN ({terms}) GROUP BY ChunkId ORDER BY raw DESC, Id LIMIT 40)"
    kn = kw + ", kn AS (SELECT Id, raw * (1 + (matched - 1) * 0.2) / max(raw * (1 + (matched - 1) * 0.2)) OVER () AS keyword FROM kw)"
    q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
    sem = lambda k: f"sem AS (SELECT Id, round(list_cosine_similarity(CAST(Embedding AS DOUBLE[]), {q}), 9) AS semantic FROM c WHERE Embedding IS NOT NULL AND len(Embedding) > 0 ORDER BY semantic DESC, Id LIMIT {k})"
    merged = kn + f", {sem(40)}, m AS (SELECT coalesce(sem.Id, kn.Id) AS Id, coalesce(semantic, 0) AS semantic, coalesce(keyword, 0) AS keyword, 0.7 * coalesce(semantic, 0) + 0.3 * coalesce(keyword, 0) AS hybrid FROM sem FULL OUTER JOIN kn ON sem.Id = kn.Id)"
    hit = " OR ".join(f"contains(lower(ClassName), '{t}') OR contains(lower(MemberName), '{t}')" for t in TERMS)
    ranked = merged + f""", k AS (SELECT c.*, m.semantic, m.keyword, m.hybrid, round(m.hybrid * CASE WHEN {hit} THEN 1.3 ELSE 1 END * CASE WHEN IsController THEN 1.1 ELSE 1 END * CASE WHEN IsService THEN 1.1 ELSE 1 END * CASE WHEN IsMiddleware THEN 1.1 ELSE 1 END
      * CASE WHEN trim(Documentation) <> '' THEN 1.05 ELSE 1 END * CASE WHEN EndLine - StartLine + 1 <= 10 THEN 0.9 ELSE 1 END * CASE WHEN length(Content) > 0 THEN greatest(0.8, least(1.0, 500.0 / length(Content))) ELSE 1 END, 9) AS final
      FROM m JOIN c ON c.Id = m.Id ORDER BY final DESC, c.Id LIMIT 20)"""
    thr = ranked + """, o AS (SELECT hybrid AS s, lead(hybrid) OVER (ORDER BY hybrid DESC) AS after, row_number() OVER (ORDER BY hybrid DESC) AS pos, count(*) OVER () AS n FROM k),
      v AS (SELECT max(CASE WHEN pos = least(CAST(floor(0.7 * n) AS BIGINT), n - 1) + 1 THEN s END) AS percentile, coalesce((SELECT after FROM o WHERE after IS NOT NULL ORDER BY s - after DESC, pos LIMIT 1), max(s)) AS gap FROM o),
      h AS (SELECT percentile, gap, least(greatest(0.4 * percentile + 0.3 * gap + 0.3 * 0.6, 0.3), 0.85) AS threshold FROM v)"""
    stored = base + ", x AS (SELECT Id, FilePath, CASE WHEN Content = '' THEN '' ELSE sha256(Content) END AS ContentHash FROM c), st AS (SELECT Id, FilePath, CASE WHEN CAST(Id AS INT) % 10 = 0 THEN 'old' ELSE ContentHash END AS ContentHash FROM x WHERE CAST(Id AS INT) % 2 = 0)"
    names = base + ", nm AS (SELECT DISTINCT term FROM (SELECT unnest([ClassName, MemberName, NamespaceName]) AS term FROM c) WHERE trim(term) <> '')"
    dist = "least(levenshtein(lower(trim(term)), 'doc7servce'), coalesce(list_min(list_transform(list_filter(" + edge % "trim(term)" + ", lambda p: length(p) >= 2), lambda p: levenshtein(lower(p), 'doc7servce'))), 1000))"
    syn = {k: v for k, v in suggest.SYNONYMS.items()}
    case = "CASE w " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in syn.items()) + " ELSE [] END"
    plain = lambda where: f"{base} SELECT Id FROM c WHERE {where}"
    runs = "WITH s AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM s) SELECT user_id, max(ts) AS fired_at, count(*) AS n_events FROM g GROUP BY user_id, run"

    def member(name: str, kind: str, signature: str, start: int, end: int) -> str:
        return f"{{'n': '{name}', 't': '{kind}', 's': '{signature}', 'a': {start}, 'b': {end}}}"

    shown = ", ".join(f"'{k}': {v}" for k, v in _JSON.items())
    return {
        "chunk_scan": f"{base} SELECT * EXCLUDE (Embedding) FROM c",
        "content_hash_map": f"{stored} SELECT Id, ContentHash FROM x",
        "content_hash": f"{base} SELECT Id, CASE WHEN Content = '' THEN '' ELSE sha256(Content) END AS hash FROM c",
        "embedded_scan": f"{base} SELECT Id, CAST(len(Embedding) AS BIGINT) AS dim FROM c WHERE Embedding IS NOT NULL AND len(Embedding) > 0",
        "distinct_files": f"{base} SELECT DISTINCT FilePath FROM c",
        "chunks_per_file": f"{base} SELECT NamespaceName, count(*) AS n FROM c GROUP BY 1",
        "point_lookup": f"{base} SELECT Id, FilePath, MemberName FROM c WHERE Id = '7' LIMIT 1",
        "filter_namespace": plain("NamespaceName ILIKE '%src1%'"),
        "filter_class": plain("ClassName ILIKE '%doc7%'"),
        "filter_http_method": plain("HttpMethods ILIKE '%post%'"),
        "filter_file_pattern": plain("FilePath ILIKE '%/en/%'"),
        "filter_chunk_type": plain("lower(MemberType) = 'method'"),
        "filter_flags": plain("IsController AND NOT IsMiddleware"),
        "filter_combined": plain("NamespaceName ILIKE '%en%' AND HttpMethods ILIKE '%get%' AND NOT IsService"),
        "semantic_id": f"{base} SELECT Id, sha256(concat_ws('|', FilePath, NamespaceName, ClassName, MemberName, MemberType, '0', coalesce(Signature, ''))) AS sid FROM c",
        "tokenize_terms": unfolded(toks("Content")),
        "ranker_terms": unfolded(rterms),
        "identifier_parts": unfolded(idparts),
        "camel_split_all": f"{base} SELECT Id, array_to_string({camel.replace('replace(p', 'replace(ClassName')}, '|') AS pieces FROM c",
        "camel_split_boundary": f"{base} SELECT Id, array_to_string(list_transform(list_filter({edge % 'ClassName'}, lambda p: length(p) >= 2), lambda p: lower(p)), '|') AS pieces FROM c",
        "keyword_postings": f"{post} SELECT ChunkId, Term, round(sum(Weight), 6) AS weight FROM p GROUP BY 1, 2",
        "extract_terms": f"{post} SELECT ChunkId, Term, Weight FROM p",
        "keyword_topk": f"{kw} SELECT Id, round(raw, 6) AS raw, matched FROM kw",
        "keyword_normalized": f"{kn} SELECT Id, round(keyword, 6) AS keyword FROM kn",
        "cosine_topk": f"{base}, {sem(20)} SELECT Id, round(semantic, 6) AS semantic FROM sem",
        "cosine_topk_filtered": f"{base}, {sem(60)} SELECT Id, round(semantic, 6) AS semantic FROM sem JOIN c USING (Id) WHERE NamespaceName ILIKE '%en%' ORDER BY sem.semantic DESC, Id LIMIT 20",
        "cosine_truncated": f"{base} SELECT Id, round(list_cosine_similarity(CAST(Embedding[1:16] AS DOUBLE[]), {q}[1:16]), 6) AS semantic FROM c WHERE Embedding IS NOT NULL AND len(Embedding) > 0",
        "hybrid_combine": f"{merged} SELECT Id, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(hybrid, 6) AS hybrid FROM m",
        "hybrid_filtered": f"{merged} SELECT m.Id, round(hybrid, 6) AS hybrid FROM m JOIN c ON c.Id = m.Id WHERE NamespaceName ILIKE '%en%'",
        "hybrid_ranked": f"{ranked} SELECT Id, round(hybrid, 6) AS hybrid, round(final, 6) AS final FROM k",
        "adaptive_threshold": f"{thr} SELECT round(percentile, 6) AS percentile, round(gap, 6) AS gap, round(threshold, 6) AS threshold FROM h",
        "effective_results": f"{thr} SELECT Id, round(hybrid, 6) AS hybrid, round(greatest(0.3, threshold), 6) AS effective FROM k JOIN h ON hybrid >= greatest(0.3, threshold) ORDER BY final DESC, Id LIMIT 5",
        "weak_match_gate": f"{ranked} SELECT round(max(hybrid), 6) AS best, max(hybrid) >= 0.30 AS suggests FROM k",
        "levenshtein_pairs": f"{names} SELECT term, CAST({dist} AS BIGINT) AS dist FROM nm",
        "suggest_top3": f"{names} SELECT term, CAST({dist} AS BIGINT) AS dist, CAST(abs(length(term) - 10) AS BIGINT) AS len_diff FROM nm WHERE lower(term) <> 'doc7servce' AND {dist} <= 3 ORDER BY dist, len_diff, term LIMIT 3",
        "query_expansion": f"{base}, qs AS (SELECT Id, CASE WHEN CAST(Id AS INT) % 2 = 0 THEN 'db File ' || NamespaceName ELSE 'plain db' END AS q FROM c), ws AS (SELECT Id, list_filter(string_split(lower(q), ' '), lambda w: w <> '') AS l FROM qs), al AS (SELECT Id, list_concat(l, flatten(list_transform(l, lambda w: {case}))) AS l FROM ws), un AS (SELECT Id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM al), di AS (SELECT Id, t, min(i) AS i FROM un GROUP BY Id, t) SELECT Id, string_agg(t, ' ' ORDER BY i) AS expanded FROM di GROUP BY Id",
        "changed_chunks": f"{stored} SELECT Id FROM x WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.Id = x.Id AND st.ContentHash = x.ContentHash)",
        "upsert_last_wins": f"{stored}, n AS (SELECT CAST(user_id % 400 AS VARCHAR) AS Id, '/e.cs' AS FilePath, CAST(max(event_id) AS VARCHAR) AS ContentHash FROM events GROUP BY 1) SELECT Id, FilePath, ContentHash FROM n UNION ALL SELECT Id, FilePath, ContentHash FROM st WHERE Id NOT IN (SELECT Id FROM n)",
        "delete_by_file": plain("FilePath <> '/src1/en/doc1.cs'"),
        "delete_missing_files": plain("CAST(Id AS INT) % 3 <> 0"),
        "orphan_edges": f"{base}, l AS (SELECT Id FROM c WHERE CAST(Id AS INT) % 4 <> 0) SELECT * FROM e WHERE SourceChunkId IN (SELECT Id FROM l) AND TargetChunkId IN (SELECT Id FROM l)",
        "callers": f"{base} SELECT c.Id, LineNumber FROM c JOIN e ON e.SourceChunkId = c.Id WHERE TargetChunkId = '5'",
        "callees": f"{base} SELECT c.Id, LineNumber FROM c JOIN e ON e.TargetChunkId = c.Id WHERE SourceChunkId = '5'",
        "impact_radius": f"WITH RECURSIVE e AS ({EDGES.replace('STRING', 'VARCHAR')}), r(id, d) AS (SELECT '5', 0 UNION ALL SELECT DISTINCT e.SourceChunkId, r.d + 1 FROM r JOIN e ON e.TargetChunkId = r.id WHERE r.d < 2) SELECT id, CAST(min(d) AS INTEGER) AS depth FROM r WHERE id <> '5' GROUP BY id",
        "resolve_calls": f"{base}, k AS (SELECT Id, concat_ws('.', NamespaceName, ClassName, MemberName) AS full_name, CASE WHEN CAST(Id AS INT) % 2 = 0 THEN 'src1.en.Doc1Service.Get' || upper(list_extract(string_split(NamespaceName, '.'), -1)) || '1' ELSE 'x.' || MemberName END AS call FROM c), ex AS (SELECT full_name, min(Id) AS t FROM k GROUP BY 1), sg AS (SELECT s, min(Id) AS t FROM (SELECT Id, unnest(string_split(full_name, '.')[2:]) AS s FROM k) GROUP BY s) SELECT k.Id AS SourceChunkId, coalesce(ex.t, sg.t) AS TargetChunkId FROM k LEFT JOIN ex ON ex.full_name = k.call LEFT JOIN sg ON sg.s = list_extract(string_split(k.call, '.'), -1) WHERE coalesce(ex.t, sg.t) IS NOT NULL",
        "line_windows": f"{base}, l AS (SELECT Id, regexp_split_to_array(Content, '\\r?\\n') AS l FROM c), w AS (SELECT Id, l, unnest(range(0, greatest(1, CAST(ceil((len(l) - 2) / 3.0) AS INT)))) AS i FROM l) SELECT Id, CAST(i AS INTEGER) AS index, CAST(i * 3 + 1 AS INTEGER) AS start_line, CAST(least(i * 3 + 5, len(l)) AS INTEGER) AS end_line, array_to_string(l[i * 3 + 1:i * 3 + 5], chr(10)) AS content FROM w",
        "needs_split": f"{base} SELECT Id, trim(Content) <> '' AND len(string_split(Content, chr(10))) > 5 AS splits FROM c",
        "content_boost": f"{base} SELECT Id, Signature || '[CLASS_BOOST] ' || ClassName || ' ' || ClassName || chr(10) || '[MEMBER_BOOST] ' || MemberName || ' ' || MemberName || ' ' || MemberName || CASE WHEN IsController THEN chr(10) || '[FRAMEWORK] controller api http' ELSE '' END || CASE WHEN IsService THEN chr(10) || '[FRAMEWORK] service business logic' ELSE '' END || CASE WHEN IsMiddleware THEN chr(10) || '[FRAMEWORK] middleware pipeline' ELSE '' END || chr(10) AS boosted FROM c",
        "build_content": f"{base} SELECT Id, array_to_string(list_filter([regexp_replace(Documentation, '^\\s+|\\s+$', '', 'g'), regexp_replace(Signature, '^\\s+|\\s+$', '', 'g')], lambda x: x <> ''), chr(10) || chr(10)) AS built FROM c",
        "debounce_events": runs,
        "watch_stream": f"{runs} HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events)",
        "parse_source_members": f"{base}, m AS (SELECT c.*, unnest([{member('_count', 'Field', 'private int _count;', 5, 5)}, {member('Title', 'Property', 'public string Title { get; set; }', 6, 6)}, {member('', 'Method', '', 7, 10)}]) AS m FROM c) SELECT FilePath, NamespaceName, ClassName, CASE m.t WHEN 'Method' THEN MemberName ELSE m.n END AS MemberName, m.t AS MemberType, CASE m.t WHEN 'Method' THEN 'public string ' || MemberName || '(int id)' ELSE m.s END AS Signature, CAST(m.a AS INTEGER) AS StartLine, CAST(m.b AS INTEGER) AS EndLine, m.t <> 'Field' AS IsService, CASE m.t WHEN 'Method' THEN 'Load' ELSE '' END AS calls FROM m",
        "embed_batch": f"{base} SELECT Id, CAST(768 AS BIGINT) AS dim, CAST(1 AS DOUBLE) AS norm FROM c WHERE regexp_matches(Content, '[A-Za-z0-9]')",
        "result_preview": f"{base} SELECT Id, CASE WHEN length(d1) > 100 THEN substr(d1, 1, 100) || '...' ELSE d1 END AS doc, CASE WHEN length(c1) > 200 THEN substr(c1, 1, 200) || '...' ELSE c1 END AS content FROM (SELECT Id, trim(replace(replace(replace(Documentation, chr(10), ' '), chr(13), ''), '///', '')) AS d1, replace(replace(Content, chr(10), ' '), chr(13), '') AS c1 FROM c)",
        "result_json": f"{ranked} SELECT Id, CAST(to_json({{{shown}, 'score': round(hybrid, 6)}}) AS VARCHAR) AS json FROM (SELECT * FROM k ORDER BY final DESC, Id LIMIT 5)",
        "result_quiet": f"{ranked} SELECT MemberName || ' — ' || FilePath || ':' || StartLine || ' (score: ' || printf('%.3f', hybrid) || ')' AS line FROM k ORDER BY final DESC, Id LIMIT 1",
    }

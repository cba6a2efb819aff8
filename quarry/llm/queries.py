"""The thin queries opN_<name> and pipeline: each applies its operator to whole tables and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, knn, licenses, lmscore, neardup, packing, pii, quality, simple8b, suffix
from quarry.llm.common import small

#: Where the installed public tokenizers are; their files stay there.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    labels = table(spark, sf_dir, "labels").where(fold() != 2).select("doc_id", F.col("quality").alias("label"))
    return quality.train(docs, labels)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good are the target, all documents the background."""
    good = table(spark, sf_dir, "labels").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("is_target", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(small(good), "doc_id", "left")
    return lmscore.cross_entropy_difference(docs)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op5_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_pack, op3_pii, op4_substring_dedup, op5_knn_join, op6_licenses, op7_decontaminate, op8_near_duplicates, op9_quality, op10_token_ids)}


SHINGLES = """
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(t, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM low),
s AS (SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
                               WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w))
"""

OP8 = f"""
WITH RECURSIVE {SHINGLES.split('WITH ', 1)[1]},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT a, a FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
smallest AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c, d.doc_id) AS BIGINT) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN smallest ON smallest.doc_id = d.doc_id
"""


OP5 = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
      FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_knn_join": OP5, "op8_near_duplicates": OP8}

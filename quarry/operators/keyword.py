"""The weighted keyword index: postings and scoring."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

#: Weights of the fields, and of identifier parts.
FIELDS = (("ClassName", 1.0), ("MemberName", 0.8), ("Signature", 0.6), ("stem", 0.4), ("NamespaceName", 0.4))
CONTENT_WEIGHT, CONTENT_TERMS = 0.3, 200
PART_WEIGHT, PART_TERMS = 0.35, 100
TERM_BONUS = 0.2


def _terms(chunks: DataFrame) -> DataFrame:
    """ChunkId, the terms of each field, body and parts; named: terms of any field; lifted: those whose entry in the body identifier parts lift."""
    # each field is tokenised once, before the rows are unfolded
    source = chunks.select(F.col("Id").alias("ChunkId"), "ClassName", "MemberName", "Signature", "NamespaceName", X.file_stem(F.col("FilePath")).alias("stem"), "Content")
    terms = source.select("ChunkId", *(X.tokenize(F.col(f)).alias(f) for f, _ in FIELDS), F.slice(X.tokenize(F.col("Content")), 1, CONTENT_TERMS).alias("body"), F.slice(X.identifier_parts(F.col("Content")), 1, PART_TERMS).alias("parts"))
    named = terms.withColumn("named", F.array_distinct(F.flatten(F.array(*(F.col(f) for f, _ in FIELDS)))))
    return named.withColumn("lifted", F.array_except(F.array_intersect("body", "parts"), "named"))


def _weighted(items, weight):
    """array<struct<Term, Weight>>: weight is a number, or a function of the term."""
    return F.transform(items, lambda t: F.struct(t.alias("Term"), (weight(t) if callable(weight) else F.lit(weight)).alias("Weight")))


def _body_weight(t):
    return F.when(F.array_contains("lifted", t), F.lit(PART_WEIGHT)).otherwise(F.lit(CONTENT_WEIGHT))


def _unfolded(terms: DataFrame, *items) -> DataFrame:
    return terms.select("ChunkId", F.explode(F.concat(*items)).alias("p")).select("ChunkId", "p.Term", "p.Weight")


def _alone():
    return _weighted(F.array_except("parts", F.array_union("named", "body")), PART_WEIGHT)


def postings(chunks: DataFrame) -> DataFrame:
    """ChunkId, Term, Weight: one row per field that has the term.

    Identifier parts lift the content's entry where no other field has the term, and stand alone where none does.
    """
    return _unfolded(_terms(chunks), *(_weighted(F.col(f), w) for f, w in FIELDS), _weighted("body", _body_weight), _alone())


def summed(chunks: DataFrame, distinct: bool = False) -> DataFrame:
    """ChunkId, Term, Weight: the postings, with one row per term and its weights added.

    They are added within each row of chunks. Only where ids may have several rows (distinct is not set) are all shuffled to add these.
    """
    def total(t):
        held = [F.when(F.array_contains(f, t), F.lit(w)).otherwise(F.lit(0.0)) for f, w in (*FIELDS, ("body", CONTENT_WEIGHT))]
        return reduce(add, held)

    rows = _unfolded(_terms(chunks), _weighted("named", total), _weighted(F.array_except("body", "named"), _body_weight), _alone())
    return rows if distinct else rows.groupBy("ChunkId", "Term").agg(F.sum("Weight").alias("Weight"))


def keyword_topk(index: DataFrame, live: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Id, raw, matched of the k chunks with the highest sums of weights. Chunks that no longer exist take no place."""
    hits = index.where(F.col("Term").isin(terms)).groupBy("ChunkId").agg(F.sum("Weight").alias("raw"), F.countDistinct("Term").alias("matched"))
    known = hits.join(live.select(F.col("Id").alias("ChunkId")), "ChunkId", "left_semi")
    return known.withColumn("raw", F.round("raw", 9)).orderBy(F.desc("raw"), "ChunkId").limit(k).select(F.col("ChunkId").alias("Id"), "raw", "matched")


def keyword_scores(top: DataFrame) -> DataFrame:
    """Id, keyword: with the bonus for several terms, over the highest of the rows given (k at most)."""
    adjusted = top.withColumn("adjusted", F.col("raw") * (1 + (F.col("matched") - 1) * TERM_BONUS))
    most = F.max("adjusted").over(Window.partitionBy())
    return adjusted.select("Id", F.when(most > 0, F.col("adjusted") / most).otherwise(F.col("adjusted")).alias("keyword"))

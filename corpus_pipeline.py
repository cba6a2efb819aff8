"""A training-data pipeline over `documents`, stage by stage.

1. quality: documents that the quality classifier scores under 0.7 go.
2. near_dedup: of each group of near-duplicate documents (Jaccard similarity of 5-word shingles of 0.8 or more,
   linked by chains) the one with the smallest doc_id stays.
3. decontaminate: documents that hold a benchmark item, exactly or edited, go.
4. pii: personal data in texts is replaced by its kind in brackets.
5. pack: documents are encoded and packed into sequences of at most 1024 tokens.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs. run() writes each stage's
result to the shared folder and rereads it. Before each stage, executors return memory that is free. Rows without
doc_id can be scored, redacted and packed, but are in no group and hold no item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, neardup, packing, pii, quality
from quarry.llm.common import Workspace, settle, small
from quarry.llm.queries import quality_model, table, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the stage's input and its labels."""
    settle(spark)
    return quality.keep_good(docs, quality_model(spark, docs, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies leave; rows that share a doc_id stay or leave together."""
    settle(spark)
    groups = neardup.near_duplicates(docs, percent=80)
    work = Workspace(spark, "near-dedup-stage")
    gone = work.save(groups.where("NOT kept").select("doc_id"), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return pii.redact(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("pack", pack_stage),
]
#: SQL can't express the classifier, the aligned passages, the trees and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after another."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = work.save(done, f"{i}-{name}") if i < len(STAGES) - 1 else done
    return docs

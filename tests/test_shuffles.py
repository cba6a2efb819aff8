"""What queries shuffle on tables too large to be broadcast, and vectors that occur twice."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from quarry.operators import keyword
from quarry.plans import queries as engine
from tests.parity import compare, connect

DIRECTORY = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
#: Queries that search texts, and the share of the texts' bytes that each may shuffle.
SHARES = {"adaptive_threshold": 0.1, "effective_results": 0.1, "hybrid_ranked": 0.1, "weak_match_gate": 0.1, "keyword_postings": 0.1}


def shuffled(spark) -> int:
    """Bytes written to shuffles since the session began."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def large(spark):
    """Plans as for large tables: nothing is broadcast by its size, and a table has several partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "200k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", sorted(SHARES))
def test_texts_stay(large, name):
    """Texts are neither shuffled by the query nor while it is built, and the rows are those of the SQL."""
    size = duckdb.sql(f"SELECT sum(strlen(text)) FROM '{DIRECTORY}/documents.parquet'").fetchall()[0][0]
    before = shuffled(large)
    result = compare(engine.queries()[name](large, DIRECTORY), connect(DIRECTORY), engine.oracle_sql()[name])
    assert result == "" and shuffled(large) - before < SHARES[name] * size


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    """The smallest tables, where every third vector but the query's occurs twice."""
    d = str(tmp_path_factory.mktemp("twice"))
    for f in os.listdir(SMALL):
        if f != "embeddings.parquet":
            os.symlink(f"{SMALL}/{f}", f"{d}/{f}")
    e = f"SELECT * FROM '{SMALL}/embeddings.parquet'"
    duckdb.sql(f"COPY ({e} UNION ALL {e} WHERE vec_id % 3 = 1) TO '{d}/embeddings.parquet' (FORMAT parquet)")
    return d


@pytest.mark.parametrize("name", ["adaptive_threshold", "cosine_topk", "cosine_topk_filtered", "extract_terms", "hybrid_combine", "hybrid_filtered", "keyword_topk", "result_json"])
def test_vectors_twice(spark, twice, name):
    assert compare(engine.queries()[name](spark, twice), connect(twice), engine.oracle_sql()[name]) == ""


def _sums(df) -> dict:
    rows = df.collect()
    found = {(r[0], r[1]): round(r[2], 6) for r in rows}
    assert len(found) == len(rows)
    return found


def test_summed(spark):
    """Sums within rows are those of the postings: empty and null fields, terms of several fields, lifted and lone parts, ids with two rows."""
    rows = [
        ("1", "/a/DatabaseService.cs", "Data.Base", "DatabaseService", "Save", "void Save(Data.Base b)", "x Auto.Tuer.Scheibe database save Data.Base auto y"), ("2", None, None, None, None, None, None),
        ("3", "", "", "", "", "", "" ), ("4", "/b.cs", "N", "Auto", "M", "int M()", "Auto.Tuer.Scheibe Auto.Tuer"), ("5", "/c.cs", "N", "C", "M", "", " ".join(f"w{i}.v{i}" for i in range(150))),
    ]
    df = spark.createDataFrame(rows, "Id string, FilePath string, NamespaceName string, ClassName string, MemberName string, Signature string, Content string")
    want = lambda df: _sums(keyword.postings(df).groupBy("ChunkId", "Term").agg(F.sum("Weight")))
    assert _sums(keyword.summed(df, True)) == want(df) == _sums(keyword.summed(df)) and want(df)
    assert _sums(keyword.summed(df.union(df))) == want(df.union(df))


def test_ids_twice(spark, tmp_path):
    """A document that occurs twice still has one row per term."""
    d = str(tmp_path)
    x = f"SELECT * FROM '{SMALL}/documents.parquet' WHERE doc_id < 20"
    duckdb.sql(f"COPY ({x} UNION ALL {x} AND doc_id < 5) TO '{d}/documents.parquet' (FORMAT parquet)")
    got = _sums(engine.queries()["keyword_postings"](spark, d))
    assert got == _sums(keyword.postings(engine.texts(spark, d)).groupBy("ChunkId", "Term").agg(F.sum("Weight")))

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import suggest, threshold
from quarry.operators.keyword import postings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokenize(spark):
    assert one(spark, X.tokenize(F.lit("MyDatabaseClass"))) == ["my", "database", "class", "mydatabaseclass"]
    assert one(spark, X.tokenize(F.lit("GetUserById"))) == ["get", "user", "by", "id", "getuserbyid"]
    assert one(spark, X.tokenize(F.lit("get_user_by_id"))) == ["get", "user", "by", "id"]
    assert one(spark, X.tokenize(F.lit("Api.Controllers.Home"))) == ["api", "controllers", "home"]
    assert one(spark, X.tokenize(F.lit(""))) == []


def test_identifier_parts(spark):
    assert one(spark, X.identifier_parts(F.lit("if (Auto.Tuer.Scheibe == 1) {"))) == ["auto", "tuer", "scheibe", "auto.tuer.scheibe"]
    for text in ("var x = 42;", "", "x.y.z"):
        assert one(spark, X.identifier_parts(F.lit(text))) == []


def test_postings(spark):
    rows = [("1", "/a/DatabaseService.cs", "N", "DatabaseService", "Save", "void Save()", "x Auto.Tuer.Scheibe y"), ("2", "/b.cs", "N", "Auto", "M", "int M()", "Auto.Tuer.Scheibe")]
    df = spark.createDataFrame(rows, "Id string, FilePath string, NamespaceName string, ClassName string, MemberName string, Signature string, Content string")
    got = {(r.ChunkId, r.Term, r.Weight) for r in postings(df).collect()}
    assert ("1", "database", 1.0) in got and ("1", "save", 0.8) in got and ("2", "scheibe", 0.35) in got and ("2", "auto.tuer.scheibe", 0.35) in got


def test_windows(spark):
    text = "\n".join(f"var x{i} = {i};" for i in range(100))
    got = one(spark, X.line_windows(F.lit(text), 30, 5))
    assert len(got) == 4 and got[-1].end_line == 100 and got[1].start_line == 26
    assert len(one(spark, X.line_windows(F.lit(None).cast("string"), 30, 5))) == 1


def test_thresholds():
    assert abs(threshold.adaptive([0.95, 0.93, 0.50, 0.48, 0.45], "specific query here") - 0.522) < 1e-9
    assert threshold.adaptive([0.10, 0.05, 0.01], "test") == 0.30
    assert threshold.adaptive([], "x") == 0.30 and threshold.adaptive([0.99, 0.98, 0.97], "specific query here") <= 0.85


def test_expand():
    assert suggest.expand("") == "" and suggest.expand("   ") == "   " and suggest.expand("unknown term") == "unknown term"
    assert set(suggest.expand("db connection").split()) >= {"db", "connection", "database", "sql"}
    table = suggest.synonyms({"db": "mysql,postgres", "custom": "value1,value2", "http": " "})
    assert table["db"] == ["mysql", "postgres"] and table["custom"] == ["value1", "value2"] and "web" in table["http"]


def test_suggest(spark):
    df = spark.createDataFrame([("DatabaseService", "Get", "Api"), ("DataStore", "Put", "Api")], "ClassName string, MemberName string, NamespaceName string")
    assert [r.term for r in suggest.suggest(df, "Databse").collect()][0] == "DatabaseService"
    assert suggest.suggest(df, "CompletelyDifferentWord").count() == 0 and suggest.suggest(df, " ").count() == 0

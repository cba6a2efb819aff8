import json
import os

import pytest

from quarry.plans import index as indexing
from quarry.plans.cli import main
from quarry.plans.search import as_json, search
from quarry.plans.server import Server
from quarry.schemas import ChunkingOptions, SearchFilter, SearchOptions
from quarry.sources import csharp
from quarry.sources.files import HashingEmbedder
from quarry.sources.store import Store
from quarry.streaming import debounce, watch

CODE = '''using System;
namespace Shop.Api
{
    /// <summary>Stores orders.</summary>
    [Route("api/orders")]
    public class OrderController : ControllerBase
    {
        private readonly IRepo _repo, _other; // { not a brace
        public int Count { get; set; } = 3;
        public string Name => "{";
        public OrderController(IRepo repo) { _repo = repo; }

        /// <summary>Loads one.</summary>
        [HttpGet("{id}")]
        public Order LoadOrder(int id,
            bool deep)
        {
            if (deep) { return _repo.Find(id); }
            return new Order(id);
        }
        private class Inner { void Save() { LoadOrder(1, false); } }
    }
    struct Skipped { public int X; }
}
class Outside { void M() {} }
'''


def test_parser():
    got = {(m.cls, m.name, m.kind) for m in csharp.parse(CODE).members}
    assert got == {("OrderController", "_repo", "Field"), ("OrderController", "Count", "Property"), ("OrderController", "Name", "Property"), ("OrderController", "OrderController", "Constructor"), ("OrderController", "LoadOrder", "Method"), ("Inner", "Save", "Method")}
    row = next(r for r in csharp.chunks("/a.cs", CODE) if r["MemberName"] == "LoadOrder")
    assert row["Signature"] == "public Order LoadOrder(int id, bool deep)" and "Loads one" in row["Documentation"] and row["HttpMethods"] == "Get"
    assert row["RouteTemplate"] == "api/orders/{id}" and row["IsController"] and "_repo.Find" in row["CallsTo"] and "Order" in row["CallsTo"]


@pytest.mark.parametrize("text", ["", "namespace A { class", "}}}{", "namespace A.B; class C { void M() => X.Y(1); }", 'namespace A { class C { string s = @"a""{"; char c = \'}\'; void M() {} } }'])
def test_parser_odd(text):
    csharp.chunks("/x.cs", text)


def test_file_scoped_and_split():
    body = "\n".join(f"        var x{i} = {i};" for i in range(100))
    rows = csharp.chunks("/x.cs", f"namespace A.B;\nclass C\n{{\n    void LongMethod()\n    {{\n{body}\n    }}\n}}\n", ChunkingOptions(20, 5))
    assert len(rows) > 1 and {r["MemberName"] for r in rows} == {"LongMethod"} and {r["NamespaceName"] for r in rows} == {"A.B"}
    every = "\n".join(r["Body"] for r in rows)
    assert all(f"var x{i} = {i};" in every for i in range(100)) and rows[-1]["Body"].rstrip().endswith("}")
    with pytest.raises(ValueError):
        ChunkingOptions(10, 10)


def test_index_search_watch(spark, tmp_path):
    source, root = tmp_path / "src", tmp_path / "store"
    (source / "bin").mkdir(parents=True)
    (source / "Orders.cs").write_text(CODE)
    store = Store(spark, str(root))
    assert indexing.index(store, str(tmp_path / "none")) == 1
    assert indexing.index(store, str(source)) == 0
    first, version = {r.Id for r in store.read("chunks").collect()}, store.version()
    assert len(first) == 6 and store.read("edges").count() >= 1 and store.read("postings").count() > 20
    assert indexing.index(store, str(source)) == 0 and store.version() == version  # nothing changed, nothing written
    result = search(store, "load order", HashingEmbedder(), SearchOptions(minimum_similarity=0.0))
    assert result.results[0].MemberName == "LoadOrder" and json.loads(as_json(result))["resultCount"] == len(result.results)
    only = search(store, "load order", HashingEmbedder(), SearchOptions(minimum_similarity=0.0), SearchFilter(http_method="get"))
    assert {r.MemberName for r in only.results} == {"LoadOrder"}
    with pytest.raises(ValueError):
        search(store, " ", HashingEmbedder())

    server = Server(store, HashingEmbedder(), SearchOptions(minimum_similarity=0.0))
    ask = lambda **x: json.loads(server.handle(json.dumps({"jsonrpc": "2.0", "id": 1} | x)))
    assert ask(method="ping")["result"] == {} and len(ask(method="tools/list")["result"]["tools"]) == 2
    assert ask(method="nope")["error"]["code"] == -32601 and json.loads(server.handle("{"))["error"]["code"] == -32700
    assert server.handle('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None
    assert ask(method="tools/call", params={"name": "x"})["error"]["code"] == -32601
    call = lambda n, **a: ask(method="tools/call", params={"name": n, "arguments": a})["result"]
    assert call("search_code")["isError"] and call("get_chunk_by_id", id="none")["content"][0]["text"] == "null"
    assert json.loads(call("search_code", query="load order", limit=1)["content"][0]["text"])["resultCount"] == 1

    # watch: an edit, a new file and a delete
    (source / "Orders.cs").write_text(CODE.replace("LoadOrder", "FetchOrder"))
    (source / "bin" / "X.cs").write_text(CODE)
    (source / "New.cs").write_text("namespace N { class K { int F; } }")
    for f in (source / "Orders.cs", source / "New.cs"):
        os.utime(f, (1e9, 1e9))
    query = watch.start(store, str(source), str(tmp_path / "state"), once=True)
    assert query.awaitTermination(120)
    names = {r.MemberName for r in store.read("chunks").collect()}
    assert "FetchOrder" in names and "LoadOrder" not in names and "F" in names
    assert not {r.ChunkId for r in store.read("postings").select("ChunkId").distinct().collect()} - {r.Id for r in store.read("chunks").collect()}
    assert store.delete_file(" ") == 0 and store.delete_file(str(source / "New.cs")) == 1
    run = lambda *a, at=root: main(["--mode", "search", "--store", str(at), *a, "--quiet"], spark)
    assert run("-q", "CLASS_BOOST OrderController OrderController MEMBER_BOOST FetchOrder FetchOrder FetchOrder public Order FetchOrder(int id, bool deep)", "-l", "x") == 0 and run("-q", "qqq zzz") == 1  # found something, found nothing
    assert run("-q", "order", at=tmp_path / "no-store") == 1 and main(["--mode", "nope"], spark) == 1


class Counting(HashingEmbedder):
    """Notes each text it embeds in a file."""

    log = ""

    def embed(self, texts):
        with open(self.log, "a") as f:
            f.writelines("x\n" for _ in texts)
        return super().embed(texts)


def test_store_of_two_directories(spark, tmp_path, monkeypatch):
    a, b, store = tmp_path / "a", tmp_path / "b", Store(spark, str(tmp_path / "store"))
    a.mkdir(), b.mkdir()
    (a / "Orders.cs").write_text(CODE)
    (a / "Bad.cs").write_bytes(b"\xef\xbb\xbfnamespace N { class Q { int A; /* \xff\xfe */ } }")
    (b / "Other.cs").write_text("namespace N { class K { int F; } }")
    log = str(tmp_path / "log")
    make = lambda: setattr(Counting, "log", log) or Counting()
    assert indexing.index(store, str(a), make) == 0 and indexing.index(store, str(b), make) == 0
    chunks = store.read("chunks").collect()
    assert {os.path.basename(r.FilePath) for r in chunks} == {"Orders.cs", "Bad.cs", "Other.cs"}
    assert len(open(log).readlines()) == len(chunks)  # each text once
    ids = sorted(r.Id for r in chunks)
    store.add_edges(spark.createDataFrame([(ids[0], ids[1], "Manual", 7)], "SourceChunkId string, TargetChunkId string, CallType string, LineNumber int"))
    other = next(r for r in chunks if r.MemberName == "F")
    (b / "Other.cs").write_text("namespace N { class K { int F; int G; } }")
    assert indexing.index(store, str(b), make) == 0
    assert store.read("edges").where("CallType = 'Manual'").count() == 1
    before = store.version()
    assert store.delete_files([r.FilePath for r in chunks if r.Id != other.Id and "Other" not in r.FilePath]) == len(chunks) - 1
    assert int(store.version().split("-")[0]) == int(before.split("-")[0]) + 1 and store.read("edges").where("CallType = 'Manual'").count() == 0


def test_changes():
    before = {"/a": (1.0, 1), "/b": (1.0, 1)}
    assert watch.changes(before, {"/a": (1.0, 1), "/c": (9.8, 1)}, 10.0) == [("/b", "delete")]
    assert watch.changes(before, {"/a": (2.0, 5), "/c": (9.8, 1)}, 10.4) == [("/a", "upsert"), ("/c", "upsert")]


def test_debounce_stream(spark, tmp_path):
    """Runs fire once newer events show that they were quiet; a second pass goes on from the first."""
    times = {"a": [0, 10, 500], "b": [5]}
    rows = [(k, t) for k, v in times.items() for t in v]
    spark.createDataFrame(rows, "k string, t long").selectExpr("k", "timestamp_seconds(t) AS ts").write.parquet(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in" / "*"))
    root = f"file://{tmp_path}/work"
    fired = lambda: sorted((r.k, int(r.fired_at.timestamp()), r.n_events) for r in debounce.drain(debounce.debounced(stream, "k", "ts", "60 seconds"), root).collect())
    assert fired() == [("a", 10, 2), ("b", 5, 1)]
    spark.createDataFrame([("b", 900)], "k string, t long").selectExpr("k", "timestamp_seconds(t) AS ts").write.parquet(str(tmp_path / "in" / "2"))
    assert fired() == [("a", 10, 2), ("a", 500, 1), ("b", 5, 1)]

"""Catalogs, parsing, descriptions, stores, streams."""

import json

import pytest
from pyspark.sql import functions as F

from graniteloom.operators import profiling
from graniteloom.sources import catalog, descriptions, parsing, stores
from graniteloom.streaming import logs


def test_catalog(spark):
    users = spark.createDataFrame([(1, "Alice", "a@x", 30), (2, "Bob", "b@x", 25), (3, "Charlie", None, 35)], "id int, name string, email string, age int")
    db = catalog.Database(spark, {"users_c": users}, {"users_c": ("id",)}, {("users_c", "age"): "ages.id"})
    t = db.describe("USERS_C")
    assert t.row_count == 3 and t.columns[0].primary_key and t.columns[3].foreign_key == "ages.id" and db.describe("users_c", upper=True).name == "USERS_C"
    assert [r["name"] for r in db.rows("SELECT name, email FROM users_c WHERE age > :age ORDER BY name", age=25)] == ["Alice", "Charlie"]
    assert [r["value"] for r in db.sample("users_c", "email").collect()] == ["a@x", "b@x"]
    with pytest.raises(ValueError):
        db.describe("nope")
    with pytest.raises(ValueError):
        catalog.connect(spark, "x", "oracle9")
    assert "lineitem" in catalog.connect(spark, "/root/testdata/sf0.001").table_names()


def test_tables_as_markdown():
    assert parsing.table_markdown("<table><tr><td>Name</td><td>Value</td></tr><tr><td>Test</td><td>123</td></tr></table>") == "| Name | Value |\n|---|---|\n| Test | 123 |"
    assert parsing.table_markdown("<table><tr><td></td></tr><tr><th>a\nb</th></tr></table>") == "| a b |\n|---|"
    assert parsing.table_markdown("<p>x</p>") == "" and parsing.table_markdown(None) == ""


def test_elements(spark):
    raw = [("f.pdf", 0, 1, "heading1", "", "<h1>Title</h1>"), ("f.pdf", 1, 1, "figure", "x", ""), ("f.pdf", 2, 1, "table", "", "<table><tr><td>A</td></tr></table>"), ("f.pdf", 3, 2, "paragraph", " text ", ""), ("f.pdf", 4, 2, "unknown", "", "")]
    e = parsing.elements(spark.createDataFrame(raw, "source_file string, id int, page int, category string, text string, html string"))
    assert [(r["type"], r["content"]) for r in e.orderBy("element_id").collect()] == [("heading", "Title"), ("table", "| A |\n|---|"), ("text", "text")]
    assert parsing.full_text(e).first()["full_text"] == "Title\n\n| A |\n|---|\n\ntext"
    assert parsing.of_type(e, "table").count() == 1
    m = spark.createDataFrame([("a.PDF",), ("b",)], "p string").select(parsing.media_type(F.col("p")).alias("m")).collect()
    assert [r["m"] for r in m] == ["application/pdf", "application/octet-stream"]


def test_descriptions(spark, tmp_path):
    (tmp_path / "hero.csv").write_text("original_column_name,column_name,column_description,data_format,value_description\nid,,the id,int,\nx,name,the name,text,examples\n,,,,\n", encoding="utf-8")
    js = [{"db_id": "d", "table_names_original": ["hero"], "column_names_original": [["-1", "*"], ["0", "name"], ["0", "power"], ["7", "lost"]], "column_descriptions": {"1": "json name", "2": "json power", "3": "x"}}]
    (tmp_path / "t.json").write_text(json.dumps(js), encoding="utf-8")
    got = {(r["table_name"], r["column_name"]): (r["description"], r["source"]) for r in descriptions.load(spark, str(tmp_path), str(tmp_path / "t.json"), "d").collect()}
    assert got == {("hero", "id"): ("the id", "csv"), ("hero", "name"): ("the name. examples", "csv"), ("hero", "power"): ("json power", "json")}
    assert descriptions.load(spark, "/nowhere", None, "d").count() == 0


def test_upsert_store(spark, tmp_path):
    p = str(tmp_path / "s")
    row = lambda *r: spark.createDataFrame(list(r), "k int, v string, made string")
    stores.upsert(spark, p, row((1, "a", "x"), (2, "b", "x")), "k")
    got = stores.upsert(spark, p, row((2, "B", "y"), (3, "c", "y")), "k", keep=("made",))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x"), (2, "B", "x"), (3, "c", "y")]
    assert stores.versions(spark, p) == [1, 2]
    # a version that was not finished does not count, and is written over
    row((9, "z", "z")).write.parquet(f"{p}/v3")
    (tmp_path / "s" / "v3" / "_SUCCESS").unlink()
    assert stores.read_store(spark, p).count() == 3
    stores.truncate(spark, p)
    assert stores.read_store(spark, p).count() == 0 and stores.versions(spark, p) == [2, 3]
    with pytest.raises(FileNotFoundError):
        stores.read_store(spark, str(tmp_path / "none"))


def test_descriptions_by_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("column_name,column_description\nnm,the name\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("value_description,original_column_name,column_description,column_name\nw,k,the key,\n,,lost,\n\"a, b\",k2,,\nlater,k2,,\n", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes(b"column_name,column_description\n\xff,x\n")
    got = {(r["table_name"], r["column_name"]): r["description"] for r in descriptions.from_csv(spark, str(tmp_path)).collect()}
    assert got == {("a", "nm"): "the name", ("b", "k"): "the key. w", ("b", "k2"): "later"}


def test_jobs_cache_vectors(spark, tmp_path):
    p = str(tmp_path / "log")
    stores.log_job(spark, p, "j", "f", "started", "1")
    stores.log_job(spark, p, "j", "f", "completed", "2", parents=3)
    assert stores.latest_jobs(spark.read.parquet(p)).first()["status"] == "completed"
    a = stores.cache_key(spark.createDataFrame([(1, None)], "x int, y string"), "y", "x")
    known, missing = stores.cached(a, a.withColumn("description", F.lit("d")))
    assert known.count() == 1 and missing.count() == 0
    v = spark.createDataFrame([("a", [1.0])], "k string, v array<float>")
    stores.save_vectors(v, str(tmp_path / "v"), "m", 1)
    assert stores.load_vectors(spark, str(tmp_path / "v"), "m", 1).count() == 1 and stores.load_vectors(spark, str(tmp_path / "v"), "other", 1) is None and stores.load_vectors(spark, "/nowhere", "m", 1) is None
    stores.drop_store(spark, str(tmp_path / "v"))
    assert stores.load_vectors(spark, str(tmp_path / "v"), "m", 1) is None


def test_log_and_streams(spark, tmp_path):
    folder = str(tmp_path / "logs")
    stores.append_entry(folder, {"timestamp": "2024-01-01T00:00:00", "type": "routing_decision", "query": "q", "scores": {"fact_only": 3.0}, "selected_path": "fact_only", "reasoning": "r"})
    e = stores.result_entry("2024-01-01T00:05:00", "q", "fact_only", {"success": True, "answer": "abc", "error": ""})
    assert e["has_error"] and e["answer_length"] == 3
    stores.append_entry(folder, e)
    stores.append_entry(folder, {"timestamp": "2024-01-01T05:00:00", "type": "error", "message": "m", "context": {}})
    r = stores.path_statistics(stores.read_log(spark, folder)).first()
    assert (r["path"], r["decisions"], r["results"], r["errors"]) == ("fact_only", 1, 1, 1)
    q = logs.windowed(logs.read_events(spark, folder), "timestamp", "type", "1 hour").writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert {r["type"] for r in spark.table("win").collect()} == {"routing_decision", "result", "error"}


def test_stream_of_frequencies(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    docs = lambda *t: spark.createDataFrame(list(t), "id int, t string").coalesce(1).write.mode("append").json(src)
    for rows in (((1, "alpha beta"),), ((2, "beta gamma"), (3, "beta"))):
        docs(*rows)
        q = logs.keep_frequencies(spark.readStream.schema("id int, t string").json(src), "id", "t", out, cp)
        q.awaitTermination(60)
    now = lambda: {r["term"]: r["df"] for r in logs.frequencies(spark, out).collect()}
    assert now() == {"alpha": 1, "beta": 3, "gamma": 1}
    logs.compact(spark, out)
    assert now() == {"alpha": 1, "beta": 3, "gamma": 1} and stores.versions(spark, f"{out}/batches") == [1]


def test_stream_batch_run_again(spark, tmp_path):
    """The first batch runs twice: its checkpoint is lost before it is noted as done."""
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([(1, "alpha beta")], "id int, t string").coalesce(1).write.json(src)
    for _ in range(2):
        logs.keep_frequencies(spark.readStream.schema("id int, t string").json(src), "id", "t", out, cp).awaitTermination(60)
        for f in (tmp_path / "cp" / "commits").glob("*0*"):
            f.unlink()
    assert {r["term"]: r["df"] for r in logs.frequencies(spark, out).collect()} == {"alpha": 1, "beta": 1}
    assert logs.frequencies(spark, str(tmp_path / "none")).count() == 0


def test_profile_checkpoint(spark, tmp_path):
    p = str(tmp_path / "prof")
    t = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert profiling.profile_new(spark, {"t": t.select("x")}, p).count() == 1
    assert profiling.profile_new(spark, {"t": t}, p).count() == 2
    r = {x["column_name"]: x for x in profiling.profile_new(spark, {"t": t}, p).collect()}
    assert r["x"]["is_numeric"] and r["y"]["null_count"] == 1 and r["y"]["common_pattern"] == "A"


def test_profile_of_nothing(spark):
    assert profiling.column_profiles(spark.createDataFrame([], "a int, b string"), "t").count() == 0
    r = profiling.column_profiles(spark.createDataFrame([(None,)], "a string"), "t").first()
    assert (r["null_count"], r["top_k_values"], r["is_numeric"], r["common_pattern"]) == (1, [], False, None)

import pytest
from pyspark.sql import functions as F

from textmill.__main__ import main
from textmill.sources import store
from textmill.sources.responses import HttpResponses, fetch_one, register


def test_collection_upserts_and_searches(spark, tmp_path):
    c = store.Collection(spark, f"file://{tmp_path}/c", 2)
    points = lambda rows: spark.createDataFrame(rows, "id string, vector array<float>, payload string")
    c.upsert(points([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "y")]))
    c.upsert(points([("a", [0.6, 0.8], "z"), ("c", [0.0, 0.0], None)]))
    assert [r.id for r in c.search([1.0, 0.0]).collect()] == ["a", "b", "c"]
    assert [r.id for r in c.search([1.0, 0.0], where=F.col("payload") == "y").collect()] == ["b"]
    with pytest.raises(ValueError):
        c.upsert(points([("d", [1.0], None)]))
    c.drop()
    assert c.read().count() == 0


def test_no_write_gate(spark, tmp_path):
    gate, path = store.Artifacts(no_write=True), f"{tmp_path}/out"
    gate.write(path, spark.range(1))
    gate.write(path, spark.range(2))
    assert gate.take()[path].count() == 2 and not gate.take() and not (tmp_path / "out").exists()
    store.Artifacts().write(path, spark.range(3))
    assert spark.read.parquet(path).count() == 3


def test_local_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><head><title>T</title></head><body><p>Hello</body></html>")
    (tmp_path / "b.txt").write_text("plain é")
    (tmp_path / "c.docx").write_bytes(b"PK")
    (tmp_path / "d").write_bytes(b"%PDF-1.4 stream\nBT (Hi) Tj ET\nendstream")
    got = {r.url.rsplit("/", 1)[1]: r for r in store.local_documents(spark, str(tmp_path)).collect()}
    assert (got["a.html"].text, got["a.html"].title, got["b.txt"].text, got["d"].text) == ("Hello", "T", "plain é", "Hi")
    assert got["c.docx"].text == "" and got["c.docx"].note == "no converter for this format"


def test_embedding_is_keyed(spark):
    df = spark.range(40).select("id", F.col("id").cast("string").alias("text"))
    got = store.embed(df, lambda ts: [[float(t), 1.0] for t in ts]).collect()
    assert all(r.vector[0] == r.id for r in got) and len(got) == 40


def test_rescue_and_observation(spark):
    responses = spark.createDataFrame([("u", 404, ""), ("v", 200, "ok"), ("w", 500, "")], "url string, status int, text string")
    shots = spark.createDataFrame([("u", "s1", "1", "old"), ("u", "s2", "2", "newer"), ("u", "s3", "3", "We use cookies"), ("w", "s", "1", "x")], "url string, snapshot_url string, timestamp string, text string")
    got = {r.url: (r.text, r.snapshot_url) for r in store.rescued(responses, shots).collect()}
    assert got == {"u": ("newer", "s2"), "v": ("ok", None), "w": ("", None)}
    df, seen = store.observed(responses.withColumn("cached", F.col("status") == 200))
    df.count()
    assert seen.get == {"rows": 3, "bytes": 2, "cached": 1}


def test_failures_are_rows(spark):
    row = fetch_one("http://127.0.0.1:9/none", timeout=1)
    assert row[1] is False and row[-1]
    register(spark)
    got = spark.read.format("responses").option("urls", "http://127.0.0.1:9/a\nhttp://127.0.0.1:9/b").option("timeout", "1").load().collect()
    assert len(got) == 2 and not any(r.ok for r in got) and HttpResponses.name() == "responses"


def test_command_line(capsys):
    assert main(["list"]) == 0 and "rank_documents" in capsys.readouterr().out
    assert main(["query", "no-such", "x"]) == 2

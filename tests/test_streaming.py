"""The streaming twins, drained once, against their batch forms."""

from pyspark.sql import functions as F

from textmill.operators import state
from textmill.streaming import twins


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_pacing(spark, tmp_path):
    rows = [("a", i, 100 * i) for i in range(6)] + [("b", i, 1000 * i) for i in range(3)]
    df = spark.createDataFrame(rows, "host string, seq long, now_ms long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(r.host, r.seq): r.departs_ms for r in drained(spark, twins.stream_host_slots(stream, 400), "paced").collect()}
    want = state.host_slots(df.withColumn("delay_ms", F.lit(400).cast("long")))
    assert got == {(r.host, r.seq): r.departs_ms for r in want.collect()}


def test_changes(spark, tmp_path):
    rows = [("u", 0, 200, "e1", None, "h"), ("u", 1, 304, None, None, None), ("u", 2, 200, "e2", None, "h"), ("u", 3, 500, None, None, None), ("v", 0, 200, None, None, "x"), ("v", 1, 200, None, None, "x")]
    df = spark.createDataFrame(rows, "url string, seq long, status int, etag string, last_modified string, content_hash string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(r.url, r.seq): (r.changed, r.via) for r in drained(spark, twins.stream_changes(stream), "judged").collect()}
    assert got == {(r.url, r.seq): (r.changed, r.via) for r in state.changes(df).collect()}


def test_windows_and_first_sightings(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, 'k' || id % 3 as k from range(180)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert drained(spark, twins.first_sightings(stream, "k", "ts"), "firsts").count() == 3
    assert drained(spark, twins.windowed_counts(stream, "ts", "k"), "counted", "complete").agg(F.sum("n")).first()[0] == 180

"""As-of joins over borders of tasks, and chains of renames of any length."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import asof
from textmill.sources import apis


def plain(rows, seen):
    out = []
    for k, t, n in rows:
        before = [(st, tie, v) for sk, st, tie, v in seen if sk == k and k is not None and st is not None and t is not None and st <= t]
        out.append((k, t, n, max(before)[2] if before else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_equals_the_plain_rule_with_a_hot_key(spark, batch):
    rng = random.Random(6)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    rows = [(key(), rng.choice([None, rng.randrange(400)]) if rng.random() < 0.1 else rng.randrange(400), i) for i in range(400)]
    seen = [(key(), rng.randrange(400) if rng.random() < 0.9 else None, i, f"v{i}") for i in range(60)]
    left, right = spark.createDataFrame(rows, "k string, t int, n int"), spark.createDataFrame(seen, "k string, t int, tie int, v string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": batch, "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = asof.asof_join(left, right, "k", "t", "k", "t", tie="tie")
        got = sorted(((r.k, r.t, r.n, r.last.v if r.last else None) for r in joined.collect()), key=repr)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert before == spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") and got == plain(rows, seen)


def test_a_hot_key_lies_in_several_tasks(spark, monkeypatch):
    left = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([(1, 5, "x")], "k int, t long, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables = []
        real = asof.written
        monkeypatch.setattr(asof, "written", lambda df, label: tables.append(real(df, label)) or tables[-1])
        out = asof.asof_join(left, right, "k", "t", "k", "t")
        assert out.where("last is null").count() == 5 and out.where("last.v = 'x'").count() == 19_995
        assert tables[0].select("part").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_sides(spark):
    left, right = spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([(1, 2, 3)], "k int, t int, v int")
    assert [r.last for r in asof.asof_join(left, right.limit(0), "k", "t", "k", "t").collect()] == [None]
    assert asof.asof_join(left.limit(0), right, "k", "t", "k", "t").collect() == []


def test_chains_end_and_circles_do_not(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(300)]
    circle = [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x")]
    star = [(f"s{i}", "hub") for i in range(200)] + [("hub", "c299")]
    odd = [("twice", "b"), ("twice", "a"), ("self", "self"), (None, "n"), ("n", None)]
    ends = {r.name: r["last"] for r in apis.last_names(spark.createDataFrame(chain + circle + star + odd, "name string, to string")).collect()}
    assert all(ends[n] == "c300" for n, _ in chain + star) and all(ends[n] is None for n, _ in circle)
    assert ends["twice"] == "a" and not {"self", "n", None} & set(ends)
    assert apis.last_names(spark.createDataFrame([], "name string, to string")).collect() == []

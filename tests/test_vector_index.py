"""The stored index against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import vector_index


def clustered(n=300, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, 8)) * 3
    x = centers[rng.integers(0, 12, n)] + rng.standard_normal((n, 8)) * 0.2
    x[50:90] = x[50]  # ties
    return x


def plain(x, questions, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = []
    for q in questions:
        score = np.round(u @ u[q], 6)
        best = np.lexsort((np.arange(len(x)), -score))[:k]
        out += [(q, int(i), place) for place, i in enumerate(best, 1)]
    return sorted(out)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("held, lists", [(4096, None), (7, 5)])
def test_equals_all_cosines(spark, monkeypatch, held, lists):
    monkeypatch.setattr(vector_index, "HELD", held)
    x = clustered()
    rows = frame(spark, x)
    index = vector_index.build_index(rows, "id", "v", lists=lists)
    got = vector_index.search_index(index, rows.where("id % 20 = 0"), "id", "v", k=6)
    assert sorted((r.question, r.id, r.place) for r in got.collect()) == plain(x, range(0, 300, 20), 6)


def test_far_lists_are_not_read_and_folders_are_pruned(spark, monkeypatch):
    x = clustered()
    rows = frame(spark, x)
    index = vector_index.build_index(rows, "id", "v", lists=12)
    asked = []
    real = vector_index._compare
    monkeypatch.setattr(vector_index, "_compare", lambda i, w, k: asked.append(w.select("list").distinct().count()) or real(i, w, k))
    out = vector_index.search_index(index, rows.where("id = 60"), "id", "v", k=5)
    assert out.count() == 5 and asked[0] == 1 and asked[1] < 6
    plan = index.vectors(spark).where(F.col("list").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:80]


def test_an_index_is_opened_again_and_odd_vectors_are_left_out(spark, tmp_path):
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [float("inf")] * 8)]
    x = clustered(100)
    rows = frame(spark, x).unionByName(spark.createDataFrame(odd, "id long, v array<double>"))
    vector_index.build_index(rows, "id", "v", path=f"file://{tmp_path}/ix")
    index = vector_index.open_index(spark, f"file://{tmp_path}/ix")
    assert index.vectors(spark).count() == 100
    got = vector_index.search_index(index, rows.where("id >= 900 or id = 1"), "id", "v", k=200)
    assert sorted(r.id for r in got.collect()) == list(range(100)) and {r.question for r in got.collect()} == {1}
    none = vector_index.build_index(rows.limit(0), "id", "v")
    assert vector_index.search_index(none, rows, "id", "v").collect() == []
    assert vector_index.search_index(index, rows.limit(0), "id", "v").collect() == []

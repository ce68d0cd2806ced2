"""Hard negatives against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import norm_buckets
from textmill.llm.queries import op13_norm_bucket_negatives


def brute(rows, every, positives=5, negatives=5):
    """``rows``: (id, whole components, label)."""
    ids, labels = np.array([r[0] for r in rows]), np.array([str(r[2]) for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.int64)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        order = np.lexsort((ids, -score))
        score = [int(s) for s in score]
        for p in [j for j in order if labels[j] == labels[i] and j != i][:positives]:
            fits = [j for j in order if labels[j] != labels[i] and 80 * score[p] <= 100 * score[j] <= 100 * score[p]]
            out += [tuple(map(int, (ids[i], ids[p], k, ids[j], score[p], score[j]))) for k, j in enumerate(fits[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_equals_all_scores_on_all_embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    whole = [(r.vec_id, np.floor(256 * np.array(r.embedding, dtype=np.float64)), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    assert got(op13_norm_bucket_negatives(spark, sf)) == brute(whole, 100)


@pytest.mark.parametrize("bucket", [16, 4096])
def test_equals_all_scores_with_many_lengths_ties_and_hot_vectors(spark, monkeypatch, bucket):
    monkeypatch.setattr(norm_buckets, "BUCKET", bucket)
    monkeypatch.setattr(norm_buckets, "CHUNK", 8)
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((600, 6)) * rng.lognormal(2, 1.2, (600, 1)))
    x[100:300] = x[100]  # a third of all rows are equal
    x[300:310] = 0
    rows = [(i, x[i], i * 7 % 3) for i in range(600)]
    df = spark.createDataFrame([(i, [float(c) for c in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    assert got(norm_buckets.mine_negatives(df, F.col("vec_id") % 20 == 0, scale=1)) == brute(rows, 20)


def test_buckets_out_of_reach_stay_closed(spark, monkeypatch):
    """What a wave opens shrinks with the k-th scores of the waves before it."""
    monkeypatch.setattr(norm_buckets, "BUCKET", 8)
    opened = []
    real = norm_buckets._wave

    def spy(dealt, chunked, found, k, same, begin, end, buckets, *rest):
        out = real(dealt, chunked, found, k, same, begin, end, buckets, *rest)
        opened.append((end - begin, out.count()))
        return out

    monkeypatch.setattr(norm_buckets, "_wave", spy)
    length = [1.5 ** -(i // 8) for i in range(160)]
    df = spark.createDataFrame([(i, [1000 * length[i], float(i % 3)], i % 2) for i in range(160)], "vec_id long, embedding array<double>, label int")
    out = norm_buckets.mine_negatives(df, F.col("vec_id") == 0, scale=1)
    assert got(out) == brute([(i, [int(1000 * length[i]), i % 3], i % 2) for i in range(160)], 160)
    width, rows = opened[2]  # the widest wave of the search for positives
    assert width > 10 and rows == 0


def test_wide_scores_are_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-(1 << 30), 1 << 30, (90, 2))
    rows = [(i, x[i], i % 2) for i in range(90)]
    df = spark.createDataFrame([(i, [float(c) for c in v], str(label)) for i, v, label in rows], "vec_id long, embedding array<double>, label string")
    assert got(norm_buckets.mine_negatives(df, F.col("vec_id") % 9 == 0, scale=1)) == brute(rows, 9)


def test_odd_tables(spark):
    good = [(i, [float(i % 5), 1.0], i % 2) for i in range(12)]
    odd = [(None, [9.0, 9.0], 0), (50, None, 0), (51, [], 0), (52, [9.0, 9.0], None), (53, [float("nan"), 1.0], 0), (54, [None, 1.0], 1), (55, [float("inf"), 1.0], 1), (56, [9.0], 1), (57, [1e30, 1.0], 1)]
    df = spark.createDataFrame([(i, v, label, 0, "x") for i, v, label in good + odd], "vec_id long, embedding array<double>, label int, rank int, uid string")
    assert got(norm_buckets.mine_negatives(df, F.col("vec_id") % 3 == 0, scale=1)) == brute(good, 3)
    twice = df.where("vec_id < 12").unionByName(df.where("vec_id = 4"))
    out = norm_buckets.mine_negatives(twice, F.col("vec_id") == 0, scale=1)
    assert len(got(out)) == len(brute([*good, good[4]], 100))
    assert norm_buckets.mine_negatives(df.limit(0), F.lit(True)).collect() == []
    assert norm_buckets.mine_negatives(df.where("vec_id = 3"), F.lit(True)).collect() == []
    assert norm_buckets.mine_negatives(df, F.lit(False)).collect() == []


def test_anchors_are_placed_once_for_both_searches(spark, sf, monkeypatch):
    """Each sort, count and told table more is driver memory: rows and anchors are sorted once each, a first wave meets no earlier finds."""
    placed, met = [], []
    ranked, wave = norm_buckets.ranked, norm_buckets._wave
    monkeypatch.setattr(norm_buckets, "ranked", lambda df, *rest: placed.append(df) or ranked(df, *rest))
    monkeypatch.setattr(norm_buckets, "_wave", lambda *args: met.append((args[2], args[5])) or wave(*args))
    assert op13_norm_bucket_negatives(spark, sf).count() > 0
    assert len(placed) == 2
    assert all((found is None) == (begin == 0) for found, begin in met)

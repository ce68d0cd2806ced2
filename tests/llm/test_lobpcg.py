"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from textmill.llm import lobpcg
from textmill.llm.queries import op11_lobpcg_whitening


def dense(x: np.ndarray, k: int):
    n = len(x)
    c = x - x.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / n)
    return e[::-1], v[:, ::-1][:, :k], c


def matrix(frame, ids):
    return frame.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()


def test_equals_a_dense_eigendecomposition_on_all_embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([np.floor(1024 * np.array(r.embedding, dtype=np.float64)) + 100_000 for r in rows])
    got = op11_lobpcg_whitening(spark, sf).toPandas()
    e, v, c = dense(x, 8)
    want = c @ v / np.sqrt(e[:8])
    white = matrix(got, [r.vec_id for r in rows])
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white * signs - want).max() < 1e-9
    assert np.abs(white.T @ white / len(x) - np.eye(8)).max() < 1e-9 and got["identity_error"].max() < 1e-9
    whole = x.astype(np.int64)
    deviation = {r.vec_id: int(d) for r, d in zip(rows, ((len(x) * whole - whole.sum(axis=0)) ** 2).sum(axis=1))}
    assert all(deviation[i] == d for i, d in zip(got["vec_id"], got["deviation"]))
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, e[:8] / e.sum(), rtol=1e-9) and set(got["n"]) == {len(x)}


def test_pairs_close_together_are_certified():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((120, 120)))
    values = np.concatenate((1 + 1e-4 * np.arange(8)[::-1], 0.9995 - 1e-3 * np.arange(112)))
    a = (q * values) @ q.T
    pairs = lobpcg.lobpcg(lambda block: a @ block, 120, 8)
    assert pairs.residuals.max() < 1e-12 and np.allclose(pairs.values, values[:8], rtol=1e-13)
    assert np.abs(np.abs((pairs.vectors * q[:, :8]).sum(axis=0)) - 1).max() < 1e-9
    with pytest.raises(RuntimeError):
        lobpcg.lobpcg(lambda block: a @ block, 120, 8, max_rounds=2)


def test_odd_tables(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.standard_normal(3)]) for i in range(20)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 0.0]), (93, [float("inf"), 0.0, 0.0]), (94, []), (95, [1.0, 2.0]), (None, good[0][1]), (0, good[0][1])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in good + odd], "vec_id long, embedding array<double>, x double, component int")
    out = lobpcg.whiten(df).toPandas()
    assert len(out) == 22 * 3 and set(out["n"]) == {22} and sorted(set(out["component"])) == [1, 2, 3]
    assert out["vec_id"].isna().sum() == 3 and out["identity_error"].max() < 1e-9
    same = lobpcg.whiten(spark.createDataFrame([(i, [1.5, 2.5]) for i in range(4)], "vec_id long, embedding array<double>")).toPandas()
    assert len(same) == 8 and same["whitened"].isna().all() and same["explained"].isna().all() and (same["deviation"] == 0).all()
    line = lobpcg.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")).toPandas()
    assert line[line["component"] == 1]["whitened"].notna().all() and line[line["component"] == 2]["whitened"].isna().all()
    assert lobpcg.whiten(df.limit(0)).collect() == [] and lobpcg.whiten(df.where("vec_id = 90")).collect() == []
    far = spark.createDataFrame([(1, [3e9, 0.0]), (2, [-3e9, 1.0])], "vec_id long, embedding array<double>")
    x = [[int(3e9 * 1024) + 100_000, 100_000], [-int(3e9 * 1024) + 100_000, 101_024]]
    want = [sum((2 * a - (b + c)) ** 2 for a, b, c in zip(r, *x)) for r in x]
    assert sorted({int(r.deviation) for r in lobpcg.whiten(far).collect()}) == sorted(set(want))
    assert lobpcg.whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect() == []

"""Whitening of embeddings with eigenvectors from a distributed LOBPCG.

The covariance matrix is never formed. A step multiplies it with a block of
directions: each batch of centred rows gives ``rows' (rows X)``, Spark adds the
parts up, and only ``dims x columns`` numbers reach the driver. Rayleigh-Ritz
on the span of iterate, residual and previous direction blocks gives the next
iterate, until the residual of every wanted pair is certified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import narrow_batches, written

#: Directions iterated beside the wanted ones: a gap behind them decides the speed, one behind the last wanted pair only its bound.
GUARD = 8
#: Components beyond this part of the largest eigenvalue are rounding, not spread.
FLAT = 1e-12


@dataclass
class Pairs:
    """Leading eigenpairs of a covariance, by falling eigenvalue, with the residual norms that certify them."""

    values: np.ndarray
    vectors: np.ndarray  # dims x pairs
    residuals: np.ndarray
    rounds: int


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def block_product(rows: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``sum of (x - mean)(x - mean)' block`` over all rows, one pass."""
    dims, width = block.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, width))
        for batch in it:
            if batch.num_rows:
                x = _matrix(batch, dims) - mean
                total += x.T @ (x @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part"])

    parts = rows.select("x").mapInArrow(run, "i int, part array<double>").select("i", F.posexplode("part").alias("j", "v"))
    summed = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((dims, width))
    out[summed["i"], summed["j"]] = summed["v"]
    return out


def _orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """A basis of the block's span, orthogonal to ``against``; what is linearly dependent leaves."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):  # a second time, for what the first leaves of rounding
        if against is not None:
            block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * max(1.0, s[0] if len(s) else 0.0)]
        if not block.shape[1]:
            break
    return block


def lobpcg(product, dims: int, wanted: int, tolerance: float = 1e-13, max_rounds: int = 500, seed: int = 5) -> Pairs:
    """The ``wanted`` largest eigenpairs of the symmetric operator ``product(block)``.

    Ends when each residual norm is at most ``tolerance`` times the largest
    eigenvalue, or, once all are below 1e-10 times it, when three rounds bring
    no further gain; raises if neither happens in ``max_rounds`` rounds.
    """
    width = min(dims, wanted + GUARD)
    wanted = min(wanted, dims)
    x = _orthonormal(np.random.default_rng(seed).standard_normal((dims, width)))
    w = p = np.zeros((dims, 0))
    best, idle = np.inf, 0
    for done in range(1, max_rounds + 1):
        basis = x
        for block in (w, p):
            if block.shape[1] and basis.shape[1] < dims:
                basis = np.hstack((basis, _orthonormal(block, basis)))
        basis = basis[:, :dims]
        image = product(basis)
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:width], y[:, ::-1][:, :width]
        after, image = basis @ y, image @ y
        residual = image - after * values
        norms = np.linalg.norm(residual, axis=0)
        scale = max(float(values[0]), np.finfo(float).tiny)
        worst = float(norms[:wanted].max()) / scale
        if worst <= tolerance or values[0] <= 0:
            break
        idle = idle + 1 if worst > best * 0.5 else 0
        best = min(best, worst)
        if worst < 1e-10 and idle >= 3:
            break
        direction = after - x @ (x.T @ after)  # the part of the step outside the last iterate
        x, w, p = after, residual, direction
    else:
        raise RuntimeError(f"residual {worst:.1e} after {max_rounds} rounds")
    return Pairs(values[:wanted], after[:, :wanted], norms[:wanted], done)


def sound(vector: str, most: float) -> Column:
    """Whether an array column is a vector: not null, not empty, all components finite and smaller than ``most``."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < most))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    A component c becomes the whole number ``floor(scale * c) + shift``.
    ``whitened`` is the centred vector projected on a unit eigenvector of the
    covariance of all usable vectors (numbered from 1 by falling eigenvalue)
    over the root of that eigenvalue; ``explained`` the eigenvalue over the
    trace; ``deviation`` the exact squared distance from the mean, times n^2;
    ``identity_error`` the largest absolute entry of the whitened covariance
    less the identity, measured in a pass over the result.

    Vectors that are null, empty, have null or non-finite components,
    components of 2^52 / ``scale`` or more (no exact whole numbers) or another
    length than most (of two lengths equally frequent, the longer) take no
    part. Equal vectors and repeated rows count each; null ids are kept. A
    component without spread (a single vector, all equal, fewer distinct
    directions than ``components``) has ``whitened`` null and no part in the
    error. There are at most as many components as dimensions. An empty table
    gives no rows; other columns, whatever their names, play no part.
    """
    spark = vectors.sparkSession
    rows = narrow_batches(vectors, id_col, vector_col).toDF("vec_id", "v").withColumn("v", F.col("v").cast("array<double>"))
    out = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    whole = F.transform("v", lambda c: F.floor(c * scale) + shift)
    rows = written(rows.where(sound("v", 2.0**52 / scale)).select("vec_id", whole.alias("x"), F.size("v").alias("dims")), "whole")
    usual = rows.groupBy("dims").count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    if usual is None:
        return spark.createDataFrame([], out)
    dims, n = usual.dims, usual["count"]
    rows = rows.where(F.col("dims") == dims)
    summed = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi")).orderBy("i").collect()
    sums = [int(r.s) for r in summed]
    farthest = sum(max(n * r.hi - s, s - n * r.lo) ** 2 for r, s in zip(summed, sums))
    exact = np.int64 if farthest < 1 << 63 and n * max(max(abs(r.lo), abs(r.hi)) for r in summed) < 1 << 63 else object
    mean = np.array([s / n for s in sums])
    pairs = lobpcg(lambda block: block_product(rows, mean, block) / n, dims, components)
    spread = pairs.values > FLAT * max(pairs.values[0], 0)
    kept = int(spread.sum())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = np.where(spread, np.sqrt(np.where(spread, pairs.values, 1)), np.nan)
        for batch in it:
            x = _matrix(batch, dims)
            flat = (x - mean) @ pairs.vectors / root
            far = n * x.astype(exact) - np.array(sums, dtype=exact)  # Python's whole numbers where 64 bits may not do
            deviation = (far * far).sum(axis=1).tolist()
            arrays = [batch.column("vec_id"), pa.array([str(int(d)) for d in deviation]), pa.array(flat.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "deviation", "w"])

    id_type = dict(rows.dtypes)["vec_id"]
    projected = written(rows.select("vec_id", "x").mapInArrow(run, f"vec_id {id_type}, deviation string, w array<double>"), "whitened")
    projected = projected.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    trace = float(projected.agg(F.sum(F.col("deviation").cast("double"))).first()[0]) / n / n / n
    error = None
    if kept:
        seen = projected.select(F.slice("w", 1, kept).alias("x"))
        center = np.array([r[0] for r in seen.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.avg("c").alias("m")).orderBy("i").select("m").collect()])
        error = float(np.abs(block_product(seen, center, np.eye(kept)) / n - np.eye(kept)).max())
    explained = [float(v / trace) if trace > 0 else None for v in pairs.values]
    told = projected.select("vec_id", "deviation", F.posexplode("w").alias("k", "white"))
    return told.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("white"), F.col("white")).alias("whitened"),
        F.element_at(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("k") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )

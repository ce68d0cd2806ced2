"""A stored index of vectors for tables of question vectors, exact in its answers.

Unit vectors lie in inverted lists, one partition folder each, with the list's
centroid and radius in a small table beside them. By the triangle inequality
nothing in a list is nearer to a question than its centroid's distance less the
radius. A question reads its nearest list first; its k-th distance there says
which other lists may hold anything better, and only these are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.cuts import work_path, written

#: Vectors of a list, and questions to it, that one task compares at a time.
HELD = 4096
MOST_LISTS, SAMPLE = 4096, 65_536
_SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """Where the lists lie, their centroids (lists x dims) and radii."""

    path: str
    centroids: np.ndarray
    radii: np.ndarray

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` of all vectors that have a direction: not null, finite, not zero."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("norm", norm).select("id", F.transform("v", lambda x: x / F.col("norm")).alias("vec"))


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Lloyd's means from random rows; one that loses all its rows stays where it is."""
    means = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        home = nearest_of(sample, means)
        filled = np.bincount(home, minlength=len(means))
        sums = np.stack([np.bincount(home, sample[:, d], len(means)) for d in range(sample.shape[1])], axis=1)
        means[filled > 0] = sums[filled > 0] / filled[filled > 0, None]
    return means


def nearest_of(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means**2).sum(axis=1) - 2 * x @ means.T).argmin(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v.values) for v in column]) if len(column) else np.zeros((0, 0))


def build_index(vectors: DataFrame, id_col: str, vector_col: str, path: str | None = None, lists: int | None = None) -> VectorIndex:
    """Write an index to ``path`` (a work folder without one) and open it.

    About sqrt(n) lists, ``MOST_LISTS`` at most; their centroids come from
    ``SAMPLE`` vectors at most, but every vector is in the index. All vectors
    have one length; those without a direction are left out.
    """
    spark = vectors.sparkSession
    path = path or work_path(spark, "vector-index")
    rows = written(unit_rows(vectors, id_col, vector_col), "unit-vectors")
    n = rows.count()
    if not n:
        return VectorIndex(path, np.zeros((0, 0)), np.zeros(0))
    wanted = min(lists or round(n**0.5), MOST_LISTS, n)
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(min(n, SAMPLE)).select("vec").toArrow().column("vec").combine_chunks())
    means = centroids_of(sample, max(1, wanted))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            home = nearest_of(x, means)
            away = np.sqrt(((x - means[home]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(away)], names=["id", "vec", "list", "away"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"id {kind}, vec array<double>, list int, away double")
    # a list's rows come from all tasks; dealt by list and a part of it, a hot list fills several files and no list many small ones
    dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (64 * HELD)))).cast("int")).repartition("list", "block").drop("block").write.partitionBy("list").parquet(f"{path}/lists")
    stored = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.max("away").alias("radius"))
    told = stored.toPandas()
    radii = np.full(len(means), -1.0)
    radii[told["list"]] = told["radius"]
    spark.createDataFrame(pd.DataFrame({"list": range(len(means)), "centroid": [m.tolist() for m in means], "radius": radii}), "list int, centroid array<double>, radius double").coalesce(1).write.parquet(f"{path}/centroids")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was written before."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return VectorIndex(path, np.array([r.centroid for r in rows]), np.array([r.radius for r in rows]))


def search_index(index: VectorIndex, questions: DataFrame, id_col: str, vector_col: str, k: int = 10, digits: int = 6) -> DataFrame:
    """The ``k`` vectors of highest cosine for every question: ``question, id, score, place``; ties by id after rounding.

    Exact: no list is left out that may hold one of them. Questions without a
    direction find nothing. Ids of questions are unique.
    """
    spark = questions.sparkSession
    asked = unit_rows(questions, id_col, vector_col)
    kind = asked.schema["id"].dataType.simpleString()
    if not len(index.radii):
        return spark.createDataFrame([], f"question {kind}, id long, score double, place int")
    means, radii = index.centroids, index.radii

    def bounds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x = _matrix(batch.column("vec"))
                far = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (means**2).sum(axis=1) - 2 * x @ means.T))
                least = np.where(radii >= 0, np.maximum(0, far - radii - _SLACK), np.inf)
                first = np.where(radii >= 0, far, np.inf).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first.astype(np.int32)), pa.array(least.tolist(), pa.list_(pa.float64()))], names=["question", "q", "first", "least"])

    asked = written(asked.mapInArrow(bounds, f"question {kind}, q array<double>, first int, least array<double>"), "questions")
    near = written(_best(_compare(index, asked.select("question", "q", F.col("first").alias("list")), k), k, digits), "near")
    kth = near.where(F.col("place") == k).select("question", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("score") - 10.0**-digits))).alias("reach"))
    wanted = asked.join(kth, "question", "left").select("question", "q", "first", "reach", F.posexplode("least").alias("list", "bound"))
    wanted = wanted.where((F.col("list") != F.col("first")) & (F.col("bound") < float("inf")) & (F.col("reach").isNull() | (F.col("bound") <= F.col("reach"))))
    more = _compare(index, written(wanted.select("question", "q", "list"), "wanted"), k)
    return _best(near.select("question", "id", "score").unionByName(more), k, digits)


def _best(found: DataFrame, k: int, digits: int) -> DataFrame:
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    return found.withColumn("score", F.round("score", digits)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _compare(index: VectorIndex, wanted: DataFrame, k: int) -> DataFrame:
    """Every question with what its lists hold, ``question, id, score``; only folders of lists that are asked for are read."""
    spark = wanted.sparkSession
    lists = [r[0] for r in wanted.select("list").distinct().collect()]  # MOST_LISTS at most
    held = index.vectors(spark).where(F.col("list").isin(lists)) if lists else index.vectors(spark).limit(0)
    sizes = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("blocks"))
    askers = wanted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("chunks"))
    both = F.broadcast(written(sizes.join(askers, "list"), "list-sizes"))
    of = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = held.join(both, "list").select("list", of("id", F.col("blocks")).alias("block"), every(F.col("chunks")).alias("chunk"), "id", "vec")
    asks = wanted.join(both, "list").select("list", every(F.col("blocks")).alias("block"), of("question", F.col("chunks")).alias("chunk"), "question", "q")
    q_type, id_type = wanted.schema["question"].dataType.simpleString(), held.schema["id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"question": left["question"][:0], "id": right["id"][:0], "score": np.zeros(0)})
        ids = right["id"].to_numpy()
        score = np.stack(left["q"]) @ np.stack(right["vec"]).T
        top = min(k, score.shape[1])
        floor = -np.partition(-score, top - 1, axis=1)[:, top - 1 : top] - 1e-6  # what rounding may tie with the last stays
        q, i = np.nonzero(score >= floor)
        return pd.DataFrame({"question": left["question"].to_numpy()[q], "id": ids[i], "score": score[q, i]})

    keys = ["list", "block", "chunk"]
    return asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(run, f"question {q_type}, id {id_type}, score double")


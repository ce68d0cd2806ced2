"""Embedding near-dedup with inverted lists and product quantisation.

Unit vectors are dealt to the inverted list of their nearest coarse centroid
and, as queries, to every list near enough to hold a partner. Inside a list the
residuals of its members are coded subspace by subspace; a query's table of
subspace distances gives asymmetric distances by look-up, and a member whose
distance, less its own coding error, is within reach is settled by its exact
cosine in double precision. The table look-up therefore loses no pair.

Neither do the probes: a link is at most the link radius long and crosses the
bisector of its ends' lists, so one end is within half the radius of it. Every
vector is stored and asks, so that end finds the other.

Vectors are compared within their label only. Equal vectors are one class with
a weight, so a hot vector costs one row. A hot (label, list) is split into
blocks of members, each block meeting all queries of the list. Links are counted
where they are found and leave a task only as counts per vector and as the
links that span its components, so a group of near-equal vectors costs rows in
proportion to its size. A pair found from both ends counts at the lesser one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import join_hot, shuffle_partitions, written
from textmill.llm.components import components
from textmill.llm.grouped import runs


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, some rows at a time."""
    step, half = max(1, 32_000_000 // len(c)), (c**2).sum(axis=1) / 2
    return np.concatenate([(x[k : k + step] @ c.T - half).argmax(axis=1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, dtype=int)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's centroids; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect: each node with the least one of its component."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


@dataclass
class Index:
    """Coarse centroids and, per subspace, residual codes."""

    coarse: np.ndarray  # lists x dims
    cuts: list[tuple[int, int]]
    books: list[np.ndarray]

    def home(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.coarse)

    def probes(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists whose bisector with the vector's own list is at most ``reach`` away."""
        home = self.home(x)
        out: list[np.ndarray] = [home[:0]] * len(x)
        for h in np.unique(home):
            mine = np.flatnonzero(home == h)
            away = self.coarse - self.coarse[h]
            apart = np.sqrt(np.maximum((away**2).sum(axis=1), 1e-18))
            middle = ((self.coarse**2).sum(axis=1) - (self.coarse[h] ** 2).sum()) / 2
            for k, near in zip(mine, (middle - x[mine] @ away.T) / apart <= reach):
                near[h] = True
                out[k] = np.flatnonzero(near)
        return out

    def encode(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the distance of each residual from its coded form."""
        codes = np.empty((len(r), len(self.cuts)), dtype=np.uint8)
        error = np.zeros(len(r))
        for j, ((lo, hi), book) in enumerate(zip(self.cuts, self.books)):
            part = r[:, lo:hi]
            codes[:, j] = (part @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
            error += ((part - book[codes[:, j]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def tables(self, r: np.ndarray) -> list[np.ndarray]:
        """Per subspace the squared distances of query residuals to every code."""
        out = []
        for (lo, hi), book in zip(self.cuts, self.books):
            part = r[:, lo:hi]
            out.append(np.maximum((part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * part @ book.T, 0))
        return out


def fit_index(sample: np.ndarray, lists: int, subspaces: int = 8) -> Index:
    """Fit on a sample of unit vectors of one dimension."""
    coarse = kmeans(sample, lists)
    residual = sample - coarse[nearest(sample, coarse)]
    edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    cuts = [(int(a), int(b)) for a, b in zip(edges, edges[1:])]
    return Index(coarse, cuts, [kmeans(residual[:, lo:hi], 256, rounds=5) for lo, hi in cuts])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def link_vectors(classes: DataFrame, threshold: float = 0.98, sample_rows: int = 65_536, max_lists: int = 8192, probe_reach: float = 0.5, block_rows: int = 4096) -> DataFrame:
    """What the classes ``(cls BIGINT, label, dims, vec ARRAY<DOUBLE>, n)`` with cosine >= ``threshold`` amount to.

    Rows ``(a, b, others)``: with ``b``, a link, all of which span the
    components; with ``others``, vectors to add to the links of ``a``. There are
    about sqrt(n) lists, ``max_lists`` at most; the index is fitted on 8 vectors
    a list and 8192 at least, ``sample_rows`` at most; every class is indexed.
    ``probe_reach`` is the share of the link radius by which a query looks over
    its list's bisectors; from 0.5 on no link is lost.
    """
    spark = classes.sparkSession
    found = spark.createDataFrame([], "a long, b long, others long")
    shapes = [(r.dims, r.n) for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("dims").collect()]
    for dims, n in shapes:
        mine = classes.where(F.col("dims") == dims).select("cls", "label", "vec", "n")
        lists = int(min(max_lists, max(1, round(n**0.5))))
        sample = mine.orderBy(F.xxhash64("cls")).limit(min(sample_rows, max(8192, 8 * lists))).select("vec").toArrow()
        index = spark.sparkContext.broadcast(fit_index(unit(_matrix(sample.column("vec"), dims)), lists))
        found = found.unionByName(_links_of_dims(mine, index, dims, threshold, probe_reach, block_rows))
    return found


def _links_of_dims(mine: DataFrame, index, dims: int, threshold: float, probe_reach: float, block_rows: int) -> DataFrame:
    spark = mine.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = unit(_matrix(batch.column("vec"), dims))
            home = index.value.home(x)
            probes = [p.tolist() for p in index.value.probes(x, radius * probe_reach)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(probes, pa.list_(pa.int32()))], names=[*batch.schema.names, "home", "probes"])

    label_type = dict(mine.dtypes)["label"]
    dealt = written(mine.mapInArrow(deal, f"cls long, label {label_type}, vec array<double>, n long, home int, probes array<int>"), "lists")
    members = dealt.groupBy("label", F.col("home").alias("list")).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    row = ["role", "cls", "n", "vec", "home", "probes"]
    stored = dealt.select("label", F.col("home").alias("list"), F.lit(0).alias("role"), *row[1:]).join(members, ["label", "list"])
    stored = stored.select("label", "list", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), *row)
    nothing = F.lit(None).cast("array<int>").alias("probes")
    asked = dealt.select("label", F.explode("probes").alias("list"), F.lit(1).alias("role"), *row[1:-1], nothing).join(members, ["label", "list"])
    asked = asked.select("label", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *row)
    keyed = stored.unionByName(asked).withColumn("group", F.xxhash64("label", "list", "block")).withColumn("label_no", F.xxhash64(F.col("label").cast("string")))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(it, ["group", "label_no", "list", "block"]):
            role, cls, n, home = (group.column(c).to_numpy() for c in ("role", "cls", "n", "home"))
            k = int((role == 0).sum())
            if not k or k == len(role):
                continue
            x = unit(_matrix(group.column("vec"), dims))
            center = index.value.coarse[int(group.column("list")[0].as_py())]
            codes, error = index.value.encode(x[:k] - center)
            lists = len(index.value.coarse)
            probed = [m * lists + p for m, ps in enumerate(group.column("probes").slice(0, k).to_pylist()) for p in ps]
            probed = np.array(probed, dtype=np.int64)  # ascending: which stored vector asks in which list
            others = np.zeros(len(x))
            step = max(1, 2_000_000 // k)
            for lo in range(k, len(x), step):
                queries = x[lo : lo + step]
                near = np.zeros((len(queries), k))
                for j, table in enumerate(index.value.tables(queries - center)):
                    near += table[:, codes[:, j]]
                q, m = np.nonzero(np.sqrt(near) <= radius + error + 1e-9)
                exact = np.einsum("ij,ij->i", queries[q], x[m])
                hit = (exact >= threshold) & (cls[lo + q] != cls[m])
                q, m = lo + q[hit], m[hit]
                if not len(q):
                    continue
                asks = m * lists + home[q]  # the pair is also found from its other end
                twice = probed[np.minimum(np.searchsorted(probed, asks), len(probed) - 1)] == asks
                mine = ~twice | (cls[q] < cls[m])
                others += np.bincount(q[mine], n[m[mine]], len(x)) + np.bincount(m[mine], n[q[mine]], len(x))
                a, b = spanning(cls[q], cls[m])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "others"])
            some = np.flatnonzero(others)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.nulls(len(some), pa.int64()), pa.array(others[some].astype(np.int64))], names=["a", "b", "others"])

    order = ["group", "label_no", "list", "block"]
    spread = keyed.repartition(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "role")
    return spread.select(*order, *row).mapInArrow(search, "a long, b long, others long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, their dimensions
    agree and their cosine is at least ``threshold``. A vector that is null,
    empty, zero, or has null or non-finite components links with nothing, and
    so does one without label: ``n_links`` 0, its own component. Equal vectors
    link with each other and count each (ties); repeated rows are vectors like
    any other. There are no texts to be long. A null id counts as a link of others and names no component. An empty
    table gives no rows; other columns, whatever their names, play no part.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.col("v").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", sound) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    # the largest component scaled to 1 keeps squares of extreme values finite
    peak = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = written(rows.select("vec_id", "label", "ok", F.when(F.col("ok"), F.transform("v", lambda x: x / peak)).alias("vec")), "vectors")
    good = rows.where("ok")
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dims", F.size("vec")), "classes")
    found = written(link_vectors(classes, threshold, **options), "vector-links")
    degree = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("cls")).agg(F.sum("others").alias("others"))
    comps = components(found.where(F.col("b").isNotNull())).select(F.col("node").alias("cls"), "component")
    told = classes.join(degree, "cls", "left").join(comps, "cls", "left").select(
        "label", "vec", "n", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")
    )
    told = written(told, "vector-classes")
    heads = told.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("of"))
    told = written(join_hot(told, written(heads, "vector-heads"), ["component"], "of").select("label", "vec", "n", "n_links", "component_id"), "vector-told")
    linked = join_hot(good, told, ["label", "vec"], "n").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

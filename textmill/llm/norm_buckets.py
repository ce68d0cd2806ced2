"""Hard-negative mining by inner product over norm-sorted buckets.

Candidates are sorted by falling norm and cut in buckets of ``BUCKET`` rows;
anchors, sorted likewise, in chunks. A chunk meets a bucket in one task. By
Cauchy-Schwarz no score exceeds the product of the norms, so an anchor needs
only the buckets whose largest norm times its own reaches what it still looks
for: the lower limit of a window or, once ``k`` rows are found, the score of
the k-th. Buckets are searched from the largest norms on in a few waves; each
wave's k-th scores decide which buckets the next one still opens, and inside a
task they run along. Scores are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.common import dropped, shuffle_partitions, written
from textmill.llm.grouped import runs
from textmill.operators.numbering import ranked

BUCKET, CHUNK, WAVES = 2048, 1024, (1 / 16, 1 / 4, 1)
#: Norm steps told apart when buckets are pruned: eight to a doubling.
STEPS = 8
_LEAST = -(1 << 62)


def _norm_step(norm: Column) -> Column:
    return F.when(norm > 0, F.floor(F.log2(norm) * STEPS).cast("int"))


def scores_of(queries: np.ndarray, rows: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products; ``most`` bounds their size. Doubles are exact below 2^53, whole numbers of 64 bits below 2^63."""
    if most < 2.0**52:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def best_of(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the columns of the ``k`` highest allowed scores, equal ones in column order: ``(row, column)``."""
    k = min(k, score.shape[1])
    masked = np.where(allowed, score, _LEAST)
    floor = -np.partition(-masked, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(allowed & (masked >= floor))
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def opened_upto(dealt: DataFrame) -> tuple[int, int, np.ndarray]:
    """How many buckets ``dealt(norm, bucket)`` has, their least norm step, and how many reach each step from there on."""
    steps = dealt.groupBy("bucket").agg(F.max("norm").alias("most")).groupBy(_norm_step(F.col("most")).alias("step")).count().collect()
    buckets = sum(r["count"] for r in steps)
    steps = [r for r in steps if r.step is not None]  # buckets of zeros are met by those that need no more than 0
    low, high = (min(r.step for r in steps), max(r.step for r in steps)) if steps else (0, 0)
    upto = np.zeros(high - low + 2, dtype=np.int64)
    for r in steps:
        upto[: r.step - low + 1] += r["count"]
    return buckets, low, upto


def search(dealt: DataFrame, queries: DataFrame, k: int, same_label: bool, reached: tuple[int, int, np.ndarray]) -> DataFrame:
    """The ``k`` best rows of every window: ``query, window, rank, id, uid, score``, ties by smaller id.

    ``dealt(uid, id, label, v, norm, bucket)`` lie in buckets of falling norm, which
    ``reached`` tells of (``opened_upto``; one bucket at least).
    ``queries(uid, id, label, v, norm, chunk, lowers, uppers)``, in chunks of falling
    norm, ask for rows of their own label, other than themselves, or of another; each
    window bounds the score, both ends included. Both should be tables, as each wave reads them.
    """
    buckets, low, upto = reached
    found, begin = None, 0
    for share in WAVES:
        end = max(1, round(buckets * share))
        if end <= begin:
            continue
        last, wave = found, _wave(dealt, queries, found, k, same_label, begin, end, buckets, low, upto)
        found = written(_best(wave if last is None else last.unionByName(wave), k), "found")
        if last is not None:
            dropped(last)
        begin = end
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "window").orderBy(F.col("score").desc(), "id", "uid")
    return found.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _wave(dealt: DataFrame, queries: DataFrame, found: DataFrame | None, k: int, same_label: bool, begin: int, end: int, buckets: int, low: int, upto: np.ndarray) -> DataFrame:
    spark = dealt.sparkSession
    asked = queries.withColumnRenamed("lowers", "limits")
    if found is not None:
        kth = found.where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        limit = lambda l, i: F.greatest(l, F.coalesce(F.col("kth")[i], F.lit(_LEAST)))
        asked = asked.join(kth, F.col("uid") == F.col("query"), "left").withColumn("limits", F.transform("limits", limit)).drop("query", "kth")
    need = F.array_min("limits").cast("double")
    # a thousandth of a step of slack keeps rounding harmless
    step = F.floor(F.log2(need / F.col("norm")) * STEPS - 0.001).cast("int") - low
    reach = F.when(need <= 0, F.lit(buckets)).when(F.col("norm") <= 0, F.lit(0)).when(step < 0, F.lit(buckets))
    reach = reach.when(step >= len(upto), F.lit(0)).otherwise(F.element_at(F.array(*[F.lit(int(u)) for u in upto]), step + 1))
    asked = asked.withColumn("reach", F.least(reach, F.lit(end)).cast("int")).where(F.col("reach") > begin)
    meets = F.explode(F.sequence(F.lit(begin), F.col("reach") - 1)).alias("bucket")
    row = ["uid", "id", "label", "v", "norm"]
    nothing = F.array().cast("array<bigint>")
    mine = asked.select("chunk", meets, F.lit(1).alias("role"), *row, "limits", "uppers")
    pairs = asked.groupBy("chunk").agg(F.max("reach").alias("reach")).select("chunk", meets)
    theirs = dealt.join(pairs, "bucket").select("chunk", "bucket", F.lit(0).alias("role"), *row, nothing.alias("limits"), nothing.alias("uppers"))
    order = ["chunk", "bucket"]
    spread = mine.unionByName(theirs).repartition(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "role", "id", "uid")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict[tuple[int, int], int] = {}  # k-th scores of this chunk's windows so far
        last = None
        for group in runs(it, order):
            role, uid, norm = (group.column(c).to_numpy() for c in ("role", "uid", "norm"))
            n = int((role == 0).sum())
            if not n or n == len(role):
                continue
            if group.column("chunk")[0].as_py() != last:
                last = group.column("chunk")[0].as_py()
                running.clear()
            ids, label = group.column("id").to_numpy(), group.column("label").dictionary_encode().combine_chunks()
            label = np.asarray((label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices)
            asks = group.slice(n)
            widths = np.diff(asks.column("limits").combine_chunks().offsets.to_numpy())
            begins = np.cumsum(widths) - widths
            limits, uppers = (asks.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("limits", "uppers"))
            window = np.arange(widths.sum()) - np.repeat(begins, widths)
            owner = np.repeat(np.arange(len(widths)), widths)
            for j, key in enumerate(zip(uid[n:][owner].tolist(), window.tolist())):
                limits[j] = max(limits[j], running.get(key, _LEAST))
            top = norm[:n].max()
            open_ = norm[n:][owner] * top * (1 + 1e-9) >= limits  # Cauchy-Schwarz
            if not open_.any():
                continue
            who = np.unique(owner[open_])
            x = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(role), -1)
            score = scores_of(x[n:][who], x[:n], norm[n:].max() * top)
            fits = (label[n:][who][:, None] == label[:n]) == same_label
            fits &= uid[n:][who][:, None] != uid[:n]
            at = np.searchsorted(who, owner)
            out = []
            for w in np.unique(window[open_]):
                j = np.flatnonzero(open_ & (window == w))
                mine = score[at[j]]
                r, c = best_of(mine, fits[at[j]] & (mine >= limits[j][:, None]) & (mine <= uppers[j][:, None]), k)
                out.append((j[r], c, mine[r, c]))
                full = np.flatnonzero(np.bincount(r, minlength=len(j)) == k)
                least = np.searchsorted(r, full, "right") - 1
                running |= {(int(uid[n + owner[j[f]]]), int(w)): int(s) for f, s in zip(full, mine[r, c][least])}
            j, c, s = (np.concatenate(v) for v in zip(*out))
            columns = [uid[n:][owner[j]], window[j].astype(np.int32), ids[c], uid[c], s]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["query", "window", "id", "uid", "score"])

    return spread.mapInArrow(run, "query long, window int, id long, uid long, score long").withColumn("rank", F.lit(0))


def mine_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    most_percent: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives.

    ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. A component c counts as the whole number
    ``floor(scale * c)``; scores are inner products; higher come first, ties by
    smaller id. ``anchors`` says which rows are; an anchor's positives are the
    first ``positives`` other rows of its label, its negatives those of other
    labels that score from ``least_percent`` to ``most_percent`` percent of the
    positive.

    Rows with a null id or label, a vector that is null or empty or has null or
    non-finite components take no part, nor do those with components of 2^31 /
    ``scale`` or more (scores are whole numbers of 64 bits), nor those whose
    length is not the most frequent (of two, the longer). Equal vectors and
    repeated rows are rows each; repeated ids are ordered arbitrarily among
    themselves. A positive score below 0 has an empty range. An empty table
    gives no rows; other columns, whatever their names, play no part.
    """
    spark = vectors.sparkSession
    marked = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = marked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: F.coalesce(F.abs(x) * scale < float(1 << 31), F.lit(False)) & ~F.isnan(x)))
    whole = rows.select("id", "label", "anchor", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.size("v").alias("dims"))
    whole = written(whole, "whole")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usual = whole.groupBy("dims").count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    if usual is None:
        return spark.createDataFrame([], out)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    kept = whole.where(F.col("dims") == usual.dims).select("id", "label", "anchor", "v", norm.alias("norm"))
    best_first = [F.col("norm").desc(), F.col("uid")]
    placed = ranked(kept.withColumn("uid", F.monotonically_increasing_id()), best_first, "place", 0)
    dealt = written(placed.withColumn("bucket", F.floor(F.col("place") / BUCKET).cast("int")).drop("place"), "buckets")
    reached = opened_upto(dealt)
    anchored = ranked(dealt.where("anchor").select("uid", "id", "label", "v", "norm"), best_first, "place", 0)
    anchored = written(anchored.withColumn("chunk", F.floor(F.col("place") / CHUNK).cast("int")).drop("place"), "queries")
    nothing = F.array(F.lit(_LEAST))
    near = search(dealt, anchored.withColumn("lowers", nothing).withColumn("uppers", F.array(F.lit(-_LEAST))), positives, True, reached)
    wide = F.col("score").cast("decimal(20,0)")
    lower = F.ceil(wide * least_percent / 100).cast("long")
    upper = F.floor(wide * most_percent / 100).cast("long")
    windows = near.select(F.col("query").alias("uid"), "rank", F.col("id").alias("positive_id"), "score", lower.alias("lower"), upper.alias("upper")).where("lower <= upper")
    by_rank = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda s: s[c])
    ranges = windows.groupBy("uid").agg(by_rank("lower").alias("lowers"), by_rank("upper").alias("uppers"), by_rank("positive_id").alias("ids"), by_rank("score").alias("scores"))
    ranges = written(anchored.join(ranges, "uid"), "windows")
    far = search(dealt, ranges.drop("ids", "scores"), negatives, False, reached)
    asked = ranges.select(F.col("uid").alias("query"), F.col("id").alias("anchor_id"), "ids", "scores")
    told = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).drop("uid").join(asked, "query")
    at = F.col("window") + 1
    return told.select("anchor_id", F.element_at("ids", at).alias("positive_id"), "rank", "negative_id", F.element_at("scores", at).alias("positive_score"), "negative_score")

"""Maximal marginal relevance over pools of any size, exactly.

An item's value, relevance less its likeness to what is already taken, can
only fall as more is taken. A round fetches the block of items with the highest
values, takes from it for as long as its best value beats that of the first
item outside, and then tells everything that is left what was taken: each pair
of items is compared once, on all cores. Inside a block only few items are
likelier to each other than to what was taken before them; these links are
found on all cores too, so that the one task that takes a block compares little
itself. Only a block is ever held in one task. Likeness is the Jaccard
similarity of term sets as a part of the largest one between any two items,
which a similarity join finds.

Terms are told apart by 64-bit hashes, so nothing here grows with the
vocabulary; intersections come from an inverted index over the block, those of
its commonest terms from a matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.cuts import dropped, written

WEIGHT = 0.75
#: Items of the first block, and items and terms that a block holds at most; it grows with what is taken.
BLOCK, GROWN, BLOCK_TERMS = 8192, 4, 1 << 23
#: Terms of a block that are multiplied as a matrix, and sets that meet a block at a time.
COMMON, AT_ONCE = 512, 128
#: Links of an item that are told to the task that takes its block; an item with more is compared there.
LINKS = 256
#: Relative error of a likeness in single precision, with room to spare: what comes so near a limit is worked out exactly.
NEAR = 1e-5
#: Seeds of the MinHash neighbours whose best similarity starts the search for the largest one.
SEEDS = (3, 5, 7, 11)


class Postings:
    """Term -> items, for intersections with all items of a block at once."""

    def __init__(self, sets: Sequence[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate([np.asarray(s, dtype=np.int64) for s in sets]) if len(sets) else np.zeros(0, np.int64)
        order = np.argsort(flat)
        flat = flat[order]
        new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
        self.terms, self.first = flat[new], np.append(np.flatnonzero(new), len(flat))
        self.items = np.repeat(np.arange(len(sets), dtype=np.uint16 if len(sets) <= 1 << 16 else np.int64), self.sizes)[order]
        self._matrix: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matrix": None}

    def _found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``words`` are terms of the block, and their places among its terms."""
        if not len(self.terms):
            return np.zeros(len(words), dtype=bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = self.terms[at] == words
        return known, at[known]

    def likeness(self, words: np.ndarray) -> np.ndarray:
        """Jaccard similarity of ``words`` to every item; 0 where either is empty."""
        both = self._counted(self._found(words)[1])
        return both / np.maximum(1, self.sizes + len(words) - both)

    def _counted(self, at: np.ndarray) -> np.ndarray:
        """How many of the terms at these places each item has."""
        lengths = self.first[at + 1] - self.first[at]
        ends = np.cumsum(lengths)
        places = np.repeat(self.first[at] - ends + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.items[places], minlength=len(self.sizes))

    def _common(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each of the commonest terms (-1: another term), and these rows over the items.

        A cell is for two items, half a block apart: a product counts ``COMMON``
        terms at most, so counts of both lie side by side in a whole number.
        """
        if self._matrix is None:
            often = np.diff(self.first)
            top = np.argsort(-often, kind="stable")[:COMMON]
            top = top[often[top] > 1]
            row = np.full(len(self.terms), -1, dtype=np.int64)
            row[top] = np.arange(len(top))
            half = (len(self.sizes) + 1) // 2
            cells = np.zeros((len(top), half), dtype=np.float32)
            for k, t in enumerate(top.tolist()):
                items = self.items[self.first[t] : self.first[t + 1]]
                cells[k, items[items < half]] = 1
                cells[k, items[items >= half] - half] += 2 * COMMON
            self._matrix = row, cells
        return self._matrix

    def shared(self, sets: Sequence[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """For ``AT_ONCE`` of ``sets`` after the other: the place of the first, and how many terms each shares with every item.

        The numbers are overwritten by the next ones.
        """
        n, (row, cells) = len(self.sizes), self._common()
        half, base = cells.shape[1], np.float32(2 * COMMON)
        words, back = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), return_inverse=True)
        known, found = self._found(words)
        place = np.full(len(words), -1, dtype=np.int64)
        place[known] = found
        ends = np.cumsum([len(s) for s in sets])
        counts, pairs, upper = (np.empty((AT_ONCE, width), dtype=np.float32) for width in (2 * half, half, half))
        for start in range(0, len(sets), AT_ONCE):
            some = [back[z - len(s) : z] for s, z in zip(sets[start : start + AT_ONCE], ends[start : start + AT_ONCE])]
            both, low, high = counts[: len(some)], pairs[: len(some)], upper[: len(some)]
            has = np.zeros((len(some), len(cells)), dtype=np.float32)
            rare = []
            for k, one in enumerate(some):
                at = place[one]
                at = at[at >= 0]
                rows = row[at]
                has[k, rows[rows >= 0]] = 1
                rare.append(at[rows < 0])
            np.matmul(has, cells, out=low)
            np.floor(np.divide(low, base, out=high), out=high)
            both[:, half:] = high
            np.subtract(low, np.multiply(high, base, out=high), out=both[:, :half])
            both = both[:, :n]
            for k, at in enumerate(rare):
                both[k] += self._counted(at).astype(np.float32)
            yield start, both

    def near(self, sets: Sequence[np.ndarray], among: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As ``shared``, with the likeness of each to every item (0 for items not ``among`` those asked for) in single precision."""
        sizes = np.maximum(self.sizes, 1).astype(np.float32)  # an item without terms shares none
        if among is not None:
            sizes[~among] = np.inf
        unions = np.empty((AT_ONCE, len(sizes)), dtype=np.float32)
        for start, both in self.shared(sets):
            own = np.array([len(s) for s in sets[start : start + AT_ONCE]], dtype=np.float32)
            union = np.add(own[:, None], sizes, out=unions[: len(own)])
            union -= both
            yield start, both, np.divide(both, union, out=union)

    def exactly(self, both: np.ndarray, items: np.ndarray, size: int) -> np.ndarray:
        """The likeness of a set of ``size`` terms to ``items``, with which it shares ``both``."""
        both = both.astype(np.int64)
        return both / np.maximum(1, self.sizes[items] + size - both)


def greedy(rel: np.ndarray, worst: np.ndarray, names: Sequence, alike: Callable[[int], tuple], most: float, outside: tuple | None = None, limit: int | None = None, weight: float = WEIGHT) -> list[int]:
    """Items of a block in the order in which they are taken.

    ``worst`` starts with the likeness to what was taken before; ``alike`` tells
    which items an item may be likelier to than they are to that, and their
    similarity. It ends when the best value does not beat ``outside``, the
    value and name of the best item elsewhere. Ties go by name.
    """
    worst = worst.copy()
    value = weight * rel - (1 - weight) * worst
    heap = [(-v, names[i], i) for i, v in enumerate(value.tolist())]
    heapify(heap)
    order: list[int] = []
    while heap and (limit is None or len(order) < limit):
        old, name, pick = heap[0]
        now = -float(value[pick])
        if now != old:  # values only fall, so one that is out of date is too high
            heapreplace(heap, (now, name, pick))
            continue
        if outside is not None and (now, name) > (-outside[0], outside[1]):
            break
        heappop(heap)
        order.append(pick)
        if most > 0:
            items, likeness = alike(pick)
            worst[items] = np.maximum(worst[items], likeness / most)
            value[items] = weight * rel[items] - (1 - weight) * worst[items]
    return order


def mmr_order(scores: np.ndarray, tokens: Sequence[set], names: Sequence[str], weight: float = WEIGHT) -> list[int]:
    """The whole order of one small pool; the best item leads, ties go by name; two or fewer keep their order."""
    if len(scores) <= 2:
        return list(range(len(scores)))
    known = {t: i for i, t in enumerate(set().union(*tokens))}
    sets = [np.sort(np.array([known[t] for t in ts], dtype=np.int64)) for ts in tokens]
    postings, most = Postings(sets), 0.0
    for i, s in enumerate(sets):
        alike = postings.likeness(s)
        alike[i] = 0
        most = max(most, float(alike.max()))
    return greedy(scores / max(scores.max(), 1e-9), np.zeros(len(scores)), list(names), lambda i: (slice(None), postings.likeness(sets[i])), most, weight=weight)


# -- the largest similarity -------------------------------------------------------------------------


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _hashed(words: str, seed: int) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w, F.lit(seed)))


def greatest_likeness(sets: DataFrame) -> float:
    """The largest Jaccard similarity between any two of ``sets(row, words ARRAY<BIGINT>)``, exactly; words in one order.

    Two equal sets end the search at once. Otherwise MinHash neighbours give a first bound t. Two sets that beat it share a term
    among the rarest ``n - ceil(t n) + 1`` of each, and their sizes differ by a
    factor of 1/t at most; only pairs that meet so are compared. The neighbours
    are read in a range sort, so a common MinHash value burdens no task; a term
    in many prefixes meets itself in slices of its sizes.
    """
    spark = sets.sparkSession
    sets = sets.where(F.size("words") > 0)
    equal = sets.groupBy(F.xxhash64("words").alias("key")).agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").first()
    if equal is not None and sets.where(F.col("row").isin(equal.a, equal.b)).select("words").distinct().count() == 1:
        return 1.0
    least = [F.array_min(_hashed("words", s)) for s in SEEDS]
    signed = sets.select("row", "words", F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), m.alias("key")) for i, m in enumerate(least)])).alias("s")).select("s.*", "words")

    def neighbours(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, before = 0.0, None
        for batch in it:
            seed, key = batch.column("seed").to_numpy(), batch.column("key").to_numpy()
            for k, words in enumerate(batch.column("words")):
                here = (seed[k], key[k]), words.values.to_numpy()
                if before is not None and before[0] == here[0]:
                    both = len(np.intersect1d(before[1], here[1], assume_unique=True))
                    best = max(best, both / (len(before[1]) + len(here[1]) - both))
                before = here
        yield pa.RecordBatch.from_arrays([pa.array([best])], names=["best"])

    near = signed.orderBy("seed", "key", F.size("words"), F.xxhash64("words")).mapInArrow(neighbours, "best double")
    bound = near.agg(F.max("best")).first()[0] or 0.0
    if bound >= 1:
        return 1.0
    words = sets.select("row", F.size("words").alias("n"), F.explode("words").alias("w"))
    shared = words.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rarest = words.join(shared, "w").withColumn("no", F.row_number().over(Window.partitionBy("row").orderBy("df", "w")))
    # terms of one item only stand before all others, so they fill the prefix too
    met = Window.partitionBy("row")
    alone = F.col("n") - F.count(F.lit(1)).over(met)
    prefix = rarest.withColumn("place", F.col("no") + alone).where(F.col("place") <= F.col("n") - F.ceil(F.lit(bound) * F.col("n") - 1e-9) + 1)
    # sizes in slices of factor 1/t: two that may beat the bound lie in the same or in touching slices
    step = F.lit(0) if bound <= 0 else F.floor(F.log(F.col("n").cast("double")) / float(max(-np.log(bound), 1e-6))).cast("long")
    keyed = written(prefix.select("w", "row", "n", "place", step.alias("slice")), "prefixes")
    left = keyed.select("w", F.explode(F.array("slice", F.col("slice") + 1)).alias("slice"), F.col("row").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("slice").alias("sa"))
    right = keyed.select("w", "slice", F.col("row").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    # what is left of both after this term bounds the intersection
    most = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb") - 1
    apart = (F.col("sa") < F.col("slice")) | ((F.col("sa") == F.col("slice")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["w", "slice"]).where(apart & (F.least("na", "nb") > bound * F.greatest("na", "nb")) & (most > bound * (F.col("na") + F.col("nb") - most)))
    pairs = written(pairs.select("a", "b").distinct(), "alike")
    compared = pairs.join(sets.select(F.col("row").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("words").alias("y")), "b")
    found = compared.agg(F.max(_jaccard(F.col("x"), F.col("y")))).first()[0]
    dropped(keyed)
    dropped(pairs)
    return max(bound, found or 0.0)


# -- the order --------------------------------------------------------------------------------------


def mmr_places(pool: DataFrame, limit: int | None = None, weight: float = WEIGHT) -> DataFrame:
    """``row, place`` from 1: all of ``pool(row BIGINT, url, score, words ARRAY<BIGINT>)``, or the first ``limit`` places.

    ``row`` is unique; ``words`` holds no term twice. Two or fewer items come
    by score. With a ``limit`` only the blocks that may hold it are compared.
    """
    spark = pool.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    pool = written(pool.select("row", "url", "score", F.array_sort("words").alias("words")).repartition(tasks), "pool")
    n, top = pool.agg(F.count(F.lit(1)), F.max("score")).first()
    wanted = n if limit is None else min(limit, n)
    if not wanted:
        return spark.createDataFrame([], "row long, place long")
    most = greatest_likeness(pool.select("row", "words")) if n > 2 else 0.0
    rel = F.col("score") / F.lit(max(float(top), 1e-9))
    left = pool.select("row", "url", rel.alias("rel"), F.lit(0.0).alias("worst"), F.size("words").alias("size"), "words")
    value = F.col("rel") * weight - F.col("worst") * (1 - weight)
    taken: list[DataFrame] = []
    done = 0
    while done < wanted:
        at_most = min(max(BLOCK, 2 * done), GROWN * BLOCK)
        heads = left.select("row", "url", value.alias("value"), "size").orderBy(F.col("value").desc(), "url", "row").limit(at_most + 1).toArrow()
        held = max(1, min(at_most, int(np.searchsorted(np.cumsum(heads.column("size").to_numpy()), BLOCK_TERMS, "right"))))
        last, *rest = heads.slice(min(held, len(heads)) - 1, 2).to_pylist()
        outside = (rest[0]["value"], (rest[0]["url"], rest[0]["row"])) if rest else None
        tied = (value == last["value"]) & ((F.col("url") < last["url"]) | ((F.col("url") == last["url"]) & (F.col("row") <= last["row"])))
        block = written(left.where((value > last["value"]) | tied), "block")
        told = spark.sparkContext.broadcast(_postings(block))
        linked = _linked(block.repartition(tasks), told, most)
        fresh = _take(linked, told, most, outside, wanted - done, done, weight)
        taken.append(fresh)
        picks = np.sort(fresh.select("row").toArrow().column("row").to_numpy())
        done += len(picks)
        if done < wanted:
            before, left = left, _told(left, told, picks, most)
            dropped(before)
        dropped(block)
        dropped(linked)
        told.destroy()
    dropped(left)
    return reduce(DataFrame.unionByName, taken)


def _sets(words: pa.Array) -> list[np.ndarray]:
    ends, flat = words.offsets.to_numpy(), words.values.to_numpy()
    return [flat[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _postings(block: DataFrame) -> tuple[np.ndarray, np.ndarray, Postings]:
    """The rows of a block in order, their likeness to what is taken, and their postings: what the driver holds of it, as few copies as may be."""
    items = block.select("row", "worst", "words").orderBy("row").toArrow()
    sets = [s for part in items.column("words").chunks for s in _sets(part)]
    return items.column("row").to_numpy(), items.column("worst").to_numpy(), Postings(sets)


def _linked(block: DataFrame, told: Broadcast, most: float) -> DataFrame:
    """A block with the ``items`` that each item is likelier to than they are to what is taken, and their ``likeness``.

    Both are null for an item with more than ``LINKS`` of them; only such a one keeps its ``words``.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, worst, postings = told.value
        limits = (worst * most * (1 - NEAR)).astype(np.float32)
        for batch in it:
            sets, places = _sets(batch.column("words")), np.searchsorted(rows, batch.column("row").to_numpy())
            items, likeness = [[] for _ in sets], [[] for _ in sets]
            for start, both, near in postings.near(sets) if most > 0 else ():
                above = near > limits
                above[np.arange(len(above)), places[start : start + len(above)]] = False
                many = above.sum(axis=1)
                for k in np.flatnonzero(many).tolist():
                    if many[k] > LINKS:
                        items[start + k] = likeness[start + k] = None
                        continue
                    at = np.flatnonzero(above[k])
                    exact = postings.exactly(both[k, at], at, len(sets[start + k]))
                    counts = exact / most > worst[at]
                    items[start + k], likeness[start + k] = at[counts], exact[counts]
            words = [None if i is not None else s for i, s in zip(items, sets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(items, pa.list_(pa.int32())), pa.array(likeness, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int64()))], names=[*same, "items", "likeness", "words"])

    same = ["row", "url", "rel", "worst"]
    return written(block.select(*same, "words").mapInArrow(run, "row long, url string, rel double, worst double, items array<int>, likeness array<double>, words array<long>"), "linked")


def _take(block: DataFrame, told: Broadcast, most: float, outside: tuple | None, wanted: int, done: int, weight: float) -> DataFrame:
    """``row, place`` of what is taken from a block, in one task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pa.Table.from_batches(list(it)).sort_by("row")  # as the postings are
        names = list(zip(items.column("url").to_pylist(), items.column("row").to_pylist()))

        words, linked, likeness = (_sets(items.column(c).combine_chunks()) for c in ("words", "items", "likeness"))
        many = items.column("items").is_null().to_numpy()

        def alike(pick: int) -> tuple:
            return (slice(None), told.value[2].likeness(words[pick])) if many[pick] else (linked[pick], likeness[pick])

        order = greedy(items.column("rel").to_numpy(), items.column("worst").to_numpy(), names, alike, most, outside, wanted, weight)
        yield pa.RecordBatch.from_arrays([items.column("row").take(pa.array(order, pa.int64())).combine_chunks(), pa.array(np.arange(done + 1, done + len(order) + 1))], names=["row", "place"])

    return written(block.repartition(1).mapInArrow(run, "row long, place long"), "taken")


def _told(left: DataFrame, told: Broadcast, picks: np.ndarray, most: float) -> DataFrame:
    """What is left without ``picks`` of the block, and its largest likeness to them as well."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _, postings = told.value
        chosen = np.isin(rows, picks)
        for batch in it:
            batch = batch.filter(pa.array(~np.isin(batch.column("row").to_numpy(), picks)))
            sets, worst = _sets(batch.column("words")), batch.column("worst").to_numpy().copy()
            for start, both, near in postings.near(sets, chosen) if most > 0 else ():
                best = near.max(axis=1)
                for k in np.flatnonzero(best > worst[start : start + len(best)] * (most * (1 - NEAR))).tolist():
                    at = np.flatnonzero(near[k] >= best[k] * np.float32(1 - NEAR))
                    worst[start + k] = max(worst[start + k], postings.exactly(both[k, at], at, len(sets[start + k])).max() / most)
            yield batch.set_column(batch.schema.get_field_index("worst"), "worst", pa.array(worst))

    return written(left.mapInArrow(run, left.schema), "left")

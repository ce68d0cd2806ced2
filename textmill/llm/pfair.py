"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are dealt into blocks, counted in what the weights are shares
of: rows, or a size such as characters. Block i of a source is released when
the source's fluid share reaches i blocks and is due when it reaches i + 1;
earliest-deadline-first over the released blocks interleaves the sources, one
block a slot, so that after every slot each source is less than one block off
its fluid share. A source that runs dry leaves its share to the others in
proportion to their weights, which the fluid curve knows in advance, so every
row is scheduled once. Shares are exact fractions, however small.

The scheduler holds one block per source. It runs in one task, whose choices
depend on each other slot by slot, and streams the schedule, 24 bytes a block,
into a table of the shared folder, to which the rows are joined. Neither the
driver nor that task sees a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.common import fresh_name, located, locator, with_offsets, written

#: Slots whose rows are numbered in one task.
SEGMENT = 4096


class Fluid:
    """The slots at which a source's fluid share reaches a number of blocks, as exact fractions.

    In virtual time v a source has received ``min(weight * v, blocks)``. The
    slot is linear in v between the ends of sources, which ``pieces`` holds.
    """

    def __init__(self, blocks: list[int], weights: list[Fraction]):
        self.weights = weights
        dry = [Fraction(n) / w for n, w in zip(blocks, weights)]
        self.ends = sorted(set(dry))
        alive, v0, t0 = sum(weights, Fraction(0)), Fraction(0), Fraction(0)
        leaving: dict[Fraction, Fraction] = {}
        for end, w in zip(dry, weights):
            leaving[end] = leaving.get(end, Fraction(0)) + w
        self.pieces = []
        for end in self.ends:
            self.pieces.append((t0 - alive * v0, alive))  # slot = shift + rate * v
            t0, v0 = t0 + alive * (end - v0), end
            alive -= leaving[end]

    def windows(self, k: int) -> Iterator[tuple[int, int]]:
        """(release, due) of source k's blocks, in order: floor and ceiling of the slots at which its share reaches i and i + 1."""
        w, i, at = self.weights[k], 0, 0
        lines = [self._line(piece, w) for piece in self.pieces]
        limits = [end * w for end in self.ends]  # the share of k up to which a piece holds
        while True:
            while at < len(limits) - 1 and limits[at] < i:
                at += 1
            a, b, den = lines[at]
            release = (a + b * i) // den
            until = at
            while until < len(limits) - 1 and limits[until] < i + 1:
                until += 1
            a, b, den = lines[until]
            yield release, -((-a - b * (i + 1)) // den)
            i += 1

    @staticmethod
    def _line(piece: tuple[Fraction, Fraction], w: Fraction) -> tuple[int, int, int]:
        """slot(i) = (a + b * i) / den, in whole numbers."""
        shift, slope = piece[0], piece[1] / w
        den = shift.denominator * slope.denominator
        return shift.numerator * slope.denominator, slope.numerator * shift.denominator, den


def pfair_slots(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """``(source, block)`` slot by slot. Sources with no blocks take no part; the others need positive weights."""
    alive = [s for s, n in enumerate(blocks) if n]
    if any(weights[s] <= 0 for s in alive):
        raise ValueError("every source with rows needs a positive weight")
    counts = [blocks[s] for s in alive]
    fluid = Fluid(counts, [Fraction(weights[s]) for s in alive])
    windows = [fluid.windows(k) for k in range(len(alive))]
    waiting = [(*next(windows[k]), k, 0) for k in range(len(alive))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(sum(counts)):
        while waiting and waiting[0][0] <= slot:
            _, due, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, k, i))
        _, k, i = heapq.heappop(ready)
        yield alive[k], i
        if i + 1 < counts[k]:
            release, due = next(windows[k])
            heapq.heappush(waiting, (max(release, slot + 1), due, k, i + 1))


def pfair_schedule(blocks: list[int], weights: list[float]) -> list[tuple[int, int]]:
    """``pfair_slots`` as a list."""
    return list(pfair_slots(blocks, weights))


def tempered(sizes: Mapping[str, int], temperature: float) -> dict[str, float]:
    """Weights in proportion to ``size ** temperature``."""
    return {s: n**temperature for s, n in sizes.items()}


def schedule(spark, names: list[str], blocks: list[int], weights: list[float], batch: int = 1 << 16) -> DataFrame:
    """The schedule as a table ``of, no, at`` (source, block, slot), streamed by one task in batches."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        first = 0

        def told() -> pa.RecordBatch:
            of = pa.array([names[s] for s, _ in held], pa.string())
            return pa.RecordBatch.from_arrays([of, pa.array([i for _, i in held], pa.int64()), pa.array(range(first, first + len(held)), pa.int64())], names=["of", "no", "at"])

        for pair in pfair_slots(blocks, weights):
            held.append(pair)
            if len(held) == batch:
                yield told()
                first += batch
                held.clear()
        yield told()

    return written(spark.range(0, 1, 1, 1).mapInArrow(run, "of string, no long, at long"), "schedule")


def _scheduled(rows: DataFrame, weights: Mapping[str, float] | None, temperature: float, order: list[str], block_size: int) -> DataFrame:
    """``rows(source, size, ...)`` with ``block``, ``slot`` and ``before``, the size of the source's rows before it."""
    sizes = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size")).collect()}
    sources = sorted(sizes)
    given = dict(weights) if weights else tempered(sizes, temperature)
    least = min(given.values(), default=1.0)
    plan = schedule(rows.sparkSession, sources, [ceil(sizes[s] / block_size) for s in sources], [given.get(s, least) for s in sources])
    at = with_offsets(rows, ["source"], order, "before", F.col("size")).withColumn("block", F.floor(F.col("before") / F.lit(block_size)).cast("long"))
    return at.join(plan, (F.col("source") == F.col("of")) & (F.col("block") == F.col("no"))).drop("of", "no").withColumnRenamed("at", "slot")


def _narrow(docs: DataFrame, source_col: str, size_col: str | None, order: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``source``, ``size`` (1 at least) and the order keys, under names of their own, and these names."""
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0)) + 1 if size_col else F.lit(1).cast("long")
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\0null"))
    keys = [f"order{i}" for i in range(len(order))]
    return docs.select(locator().alias("row"), source.alias("source"), size.alias("size"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys)]), keys


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.7,
    source_col: str = "source",
    size_col: str | None = None,
    order: tuple[str, ...] = ("doc_id",),
    block_rows: int = 64,
    block_size: int = 131_072,
    prefix: str = "mix_",
) -> DataFrame:
    """Append to every row its place in the mixture: ``mix_block``, ``mix_slot``, ``mix_position``.

    ``weights``: target share per source (any scale; zero or less for a source
    with rows raises ValueError); without it, shares in proportion to
    size ** ``temperature``. A null source is the source ``'\\\\0null'`` and
    sources without a weight get the least given one. Shares count rows, in
    blocks of ``block_rows``, or with ``size_col`` that column plus 1 (null or
    negative: 1), in blocks of ``block_size``.
    All rows come back once, nulls and repeated rows too; ``mix_position`` is
    gapless from 0. A row longer than a block leaves the source's next slots
    empty, as it has used them up. Rows that agree in source and ``order``
    (ties) are interchangeable. An empty table gives no rows; clashing column
    names get underscores in front.
    """
    scan = located(docs)
    rows, keys = _narrow(scan, source_col, size_col, order)
    placed = written(_scheduled(written(rows, "mix-rows"), weights, temperature, keys, block_size if size_col else block_rows).select("row", "block", "slot", "before"), "mix-slots")
    segment = F.floor(F.col("slot") / F.lit(SEGMENT))
    counts = placed.groupBy(segment.alias("of")).count()
    bases = counts.select("of", F.coalesce(F.sum("count").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("segment").orderBy("slot", "before", "row"))
    told = placed.withColumn("segment", segment).join(bases, F.col("segment") == F.col("of")).select("row", "block", "slot", (F.col("base") + inside - 1).cast("long").alias("position"))
    name = {k: fresh_name(docs, prefix + k) for k in ("at", "block", "slot", "position")}
    told = told.select(F.col("row").alias(name["at"]), *[F.col(k).alias(name[k]) for k in ("block", "slot", "position")])
    return scan.withColumn(name["at"], locator()).join(told, name["at"]).select(*[F.col(f"`{c}`") for c in docs.columns], name["block"], name["slot"], name["position"])


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.7, source_col: str = "source", size_col: str | None = None, order: tuple[str, ...] = ("doc_id",), block_rows: int = 64, block_size: int = 131_072) -> DataFrame:
    """``docs`` with unchanged columns, its rows laid out in mixture order: range partitions of consecutive slots, sorted.

    Options, nulls, ties, long and repeated rows as in ``mix``; all rows come
    back, an empty table gives none back.
    """
    scan = located(docs)
    rows, keys = _narrow(scan, source_col, size_col, order)
    placed = written(_scheduled(written(rows, "mix-rows"), weights, temperature, keys, block_size if size_col else block_rows).select("row", "slot", "before"), "mix-slots")
    name = {k: fresh_name(docs, "mix_" + k) for k in ("row", "slot", "before")}
    placed = placed.select(*[F.col(k).alias(name[k]) for k in name])
    told = scan.withColumn(name["row"], locator()).join(placed, name["row"])
    by = [name["slot"], name["before"]]
    return told.repartitionByRange(*by).sortWithinPartitions(*by).select(*[F.col(f"`{c}`") for c in docs.columns])


def in_written_order(docs: DataFrame) -> DataFrame:
    """A Parquet scan's rows in the order in which they were written, whatever the sizes of its files.

    A scan deals its files by size. Writers number files by partition, so that
    file number (longer names are higher ones) and row index are the order of
    ``mixed``; range partitions of both restore it.
    """
    scan = located(docs)
    file, row = fresh_name(scan, "mix_file"), fresh_name(scan, "mix_row")
    told = scan.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    keys = [F.length(file), F.col(file), F.col(row)]
    return told.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(file, row)

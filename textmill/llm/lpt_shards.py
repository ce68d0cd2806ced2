"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups are sorted by
bytes and dealt, largest first, to the least-loaded shard through a heap.

The heap sees every group, but in runs: groups of equal bytes are
interchangeable, so of a run only its length matters and what comes out is how
many of it each shard takes. A long run is a water level: the shards take the
smallest of the loads they would reach. Runs have different bytes, which add up
to at most the whole input, so there are at most sqrt(2 x bytes) of them (14
million for 100 TB of texts all of different lengths); nothing else reaches
the driver. Inside a run the groups are numbered in Spark and dealt by number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import join_hot, narrow_batches, with_gapless_index, written

SHORT_RUN = 32


def least_loaded(items: list[tuple], shards: int, loads: list[int] | None = None) -> dict:
    """``item -> shard`` for (bytes, item) pairs, largest first, ties by item."""
    heap = [(load, s) for s, load in enumerate(loads or [0] * shards)]
    heapq.heapify(heap)
    placed = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shares_of_run(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` groups of ``size`` bytes each shard takes: what the heap gives, at once for a long run."""
    if n <= SHORT_RUN:
        placed = least_loaded([(size, i) for i in range(n)], len(loads), loads)
        return [sum(s == k for s in placed.values()) for k in range(len(loads))]

    def below(level: int) -> list[int]:
        """How often each shard is the least loaded at a load of at most ``level``."""
        return [max(0, (level - load) // size + 1) for load in loads]

    lo, hi = min(loads) - 1, max(loads) + size * n  # at lo nothing is taken, at hi n at least
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if sum(below(mid)) <= n else (lo, mid)
    taken = below(lo)
    rest = n - sum(taken)
    for k, load in enumerate(loads):  # those that reach the next level go in the order of the shards
        if rest and hi >= load and (hi - load) % size == 0:
            taken[k] += 1
            rest -= 1
    return taken


def dealt_runs(runs: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For runs (bytes, groups), largest first: bytes, and the numbers of the run at which each shard's part ends."""
    loads = [0] * shards
    for size, n in runs:
        taken = shares_of_run(loads, size, n)
        loads = [load + size * k for load, k in zip(loads, taken)]
        yield size, list(accumulate(taken))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal whole documents to ``shards`` shards of nearly equal bytes, equal texts together.

    Returns one row per input row: the id, ``size`` (UTF-8 bytes plus 1),
    ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` (gapless from 0 in
    its shard), ``grown_shard`` (null: this law does not define it). Loads
    differ by at most the largest group's bytes.

    Null texts count as empty and share the group of empty texts; null ids and
    repeated rows are rows like any other; a very long text is a group of its
    size, placed before the shorter ones; groups of equal bytes (ties) are dealt
    in an order of their digests; an empty table gives no rows; other columns,
    whatever their names, play no part.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        narrow_batches(docs, id_col, text_col).toDF("doc_id", "text").select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "sizes",
    )
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    counts = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.col("bytes").desc()).toArrow()
    runs = zip(*(counts.column(c).to_pylist() for c in ("bytes", "groups")))
    size, ends = zip(*dealt_runs(runs, shards)) if counts.num_rows else ((), ())
    dealt = written(spark.createDataFrame(pa.table({"bytes": pa.array(size, pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64()))})), "runs")
    numbered = with_gapless_index(groups, ["bytes"], ["digest"], "number").join(dealt, "bytes")
    placed = written(numbered.select("digest", "n", F.size(F.filter("ends", lambda e: e <= F.col("number"))).alias("shard")), "placed")
    told = join_hot(rows, placed, ["digest"], "n").select("doc_id", "size", "text_crc32", "shard")
    return with_gapless_index(told, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

"""Pairs of 64-bit hashes within a number of bits, by multi-index hashing.

The bits are cut in blocks. Two hashes at most r bits apart are near in one
block: with m blocks and r = a m + b, within a bits in one of the first b + 1
or within a - 1 in one of the others. So a hash looks up, block by block, the
values in that radius around its own; what it finds is settled by counting all
bits. More hashes make wider blocks worth their larger neighbourhoods; the
number of blocks comes from the number of hashes.

A block's values are dealt by their upper bits. Flips of these are enumerated
when a hash is sent to look up, flips of the lower ones by the task that holds
the values. A part that holds too many hashes is split, and so are those that
look up in it.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.cuts import written

#: Hashes of either kind that a task holds of one part.
HELD = 1 << 18


def blocks_of(bits: int, m: int) -> list[tuple[int, int, int]]:
    """``(lowest bit, width, radius)`` of ``m`` blocks of 64 bits; blocks with radius below 0 find nothing and are left out."""
    edges = [64 * k // m for k in range(m + 1)]
    a, b = divmod(bits, m)
    return [(lo, hi - lo, min(hi - lo, a if k <= b else a - 1)) for k, (lo, hi) in enumerate(zip(edges, edges[1:])) if k <= b or a > 0]


def look_ups(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def best_blocks(n: int, bits: int) -> list[tuple[int, int, int]]:
    """The blocks with the fewest look-ups and hits a hash, if hashes are spread evenly."""
    cost = lambda m: sum(look_ups(w, r) * (1 + n / 2**w) for _, w, r in blocks_of(bits, m))
    return blocks_of(bits, min(range(1, min(64, bits + 1) + 1), key=cost))


def masks(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits with at most ``radius`` ones, fewest ones first."""
    return [sum(1 << b for b in ones) for k in range(min(radius, width) + 1) for ones in combinations(range(width), k)]


def hash_pairs(items: DataFrame, id_col: str, hash_col: str, max_bits: int, held: int = HELD) -> DataFrame:
    """Pairs ``(a, b, bits)``, a < b, of rows whose hashes (BIGINT) differ in at most ``max_bits`` bits; each pair once.

    Ids are unique. Rows without id or hash pair with nothing. Meant for hashes
    without large groups of equal ones: these pair with each other.
    """
    rows = written(items.select(F.col(id_col).alias("id"), F.col(hash_col).cast("bigint").alias("h")).where("id is not null and h is not null"), "hashes-in")
    n = rows.count()
    blocks = best_blocks(max(2, n), max_bits)
    upper = [min(w, max(3, ceil(log2(max(2, n) / held)) if n > held else 3)) for _, w, _ in blocks]
    dealt, sent = [], []
    for k, ((lo, width, radius), top) in enumerate(zip(blocks, upper)):
        value = F.shiftrightunsigned("h", lo).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        part = F.shiftrightunsigned(value, width - top).cast("int")
        flips = masks(top, radius)
        dealt.append(F.array(F.struct(F.lit(k).alias("block"), part.alias("part"), F.lit(0).alias("used"))))
        sent.append(F.array(*[F.struct(F.lit(k).alias("block"), part.bitwiseXOR(F.lit(f)).alias("part"), F.lit(f.bit_count()).alias("used")) for f in flips]))
    keep = rows.select("id", "h", F.explode(F.concat(*dealt)).alias("s")).select("id", "h", "s.*")
    ask = rows.select("id", "h", F.explode(F.concat(*sent)).alias("s")).select("id", "h", "s.*")
    # at most blocks x 2^upper rows, so these sizes may be told to everybody
    size = lambda rows, out: rows.groupBy("block", "part").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias(out))
    splits = F.broadcast(written(size(keep, "parts").join(size(ask, "askers"), ["block", "part"]), "parts"))
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keep = keep.join(splits, ["block", "part"]).withColumn("i", mine(F.col("parts"))).withColumn("j", every(F.col("askers")))
    ask = ask.join(splits, ["block", "part"]).withColumn("j", mine(F.col("askers"))).withColumn("i", every(F.col("parts")))
    columns = ["block", "part", "i", "j", "id", "h", "used"]
    both = keep.select(*columns, F.lit(False).alias("asks")).unionByName(ask.select(*columns, F.lit(True).alias("asks")))

    def look_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, top = key[0], upper[key[0]]
        lo, width, radius = blocks[block]
        low = np.uint64((1 << (width - top)) - 1)
        h = pdf["h"].to_numpy(np.int64).view(np.uint64)
        ids, asks, used = pdf["id"].to_numpy(), pdf["asks"].to_numpy(), pdf["used"].to_numpy()
        value = (h >> np.uint64(lo)) & low if lo < 64 else h
        kept = np.flatnonzero(~asks)
        kept = kept[np.argsort(value[kept], kind="stable")]
        sorted_values = value[kept]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for flip in masks(width - top, radius):
            q = np.flatnonzero(asks & (used + flip.bit_count() <= radius))
            wanted = value[q] ^ np.uint64(flip)
            first = np.searchsorted(sorted_values, wanted)
            count = np.searchsorted(sorted_values, wanted, "right") - first
            for begin in range(0, len(q), 1 << 16):  # so many hits at a time that they fit
                some = slice(begin, begin + (1 << 16))
                c = count[some]
                left = np.repeat(q[some], c)
                right = kept[np.repeat(first[some] - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(c.sum())]
                apart = h[left] ^ h[right]
                near = (np.bitwise_count(apart) <= max_bits) & (ids[left] < ids[right])
                for at, wide, reach in blocks[:block]:  # told by an earlier block already
                    near &= np.bitwise_count((apart >> np.uint64(at)) & np.uint64((1 << wide) - 1)) > reach
                if near.any():
                    found.append((left[near], right[near]))
        left, right = (np.concatenate(v) if found else np.zeros(0, int) for v in (zip(*found) if found else ((), ())))
        return pd.DataFrame({"a": ids[left], "b": ids[right], "bits": np.bitwise_count(h[left] ^ h[right]).astype(np.int32)})

    kind = rows.schema["id"].dataType.simpleString()
    return both.groupBy("block", "part", "i", "j").applyInPandas(look_up, f"a {kind}, b {kind}, bits int")

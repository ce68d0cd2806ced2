"""64-bit FNV-1a and SimHash over terms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.batched import per_value
from textmill.functions.text import _col, text_terms

# Fixed values of the hash.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
#: Texts whose shingles a worker hashes together.
TOGETHER = 32


def fnv1a64(c: Column | str) -> Column:
    """FNV-1a over UTF-16 code units, as 16 hex digits; null for null.

    Two 32-bit halves carry the product, so nothing overflows under ANSI rules.
    """
    s = F.encode(_col(c), "UTF-16BE")
    half = 0xFFFFFFFF
    n = F.octet_length(s)
    units = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.hex(F.substring(s, i, F.lit(2))), 16, 10).cast("bigint")))
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("bigint").alias("hi"), F.lit(FNV_OFFSET & half).cast("bigint").alias("lo"))

    def step(acc, unit):
        x = acc["lo"].bitwiseXOR(unit)
        low = x * 0x1B3
        hi = (acc["hi"] * 0x1B3 + x * 256 + F.shiftright(low, 32)).bitwiseAND(F.lit(half))
        return F.struct(hi.alias("hi"), low.bitwiseAND(F.lit(half)).alias("lo"))

    text = lambda acc: F.lower(F.concat(F.lpad(F.hex(acc["hi"]), 8, "0"), F.lpad(F.hex(acc["lo"]), 8, "0")))
    return F.when(n == 0, F.lit(f"{FNV_OFFSET:016x}")).when(n > 0, F.aggregate(units, start, step, text))


def hash_spans(units: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a of many spans of one buffer of UTF-16 units at once, as unsigned integers."""
    out = np.full(len(starts), FNV_OFFSET, dtype=np.uint64)
    order = np.argsort(-lengths, kind="stable")  # longest first: the spans that go on are always a head of them
    begin, left, h = starts[order], lengths[order], out[order]
    live = np.searchsorted(-left, -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
    for k, n in enumerate(live.tolist()):
        h[:n] = (h[:n] ^ units[begin[:n] + k]) * np.uint64(FNV_PRIME)
    out[order] = h
    return out


def hash_units(texts: list[str]) -> np.ndarray:
    """FNV-1a of many strings at once, as unsigned integers."""
    coded = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
    lengths = np.array([len(c) for c in coded], dtype=np.int64)
    units = np.concatenate(coded).astype(np.uint64) if coded else np.zeros(0, np.uint64)
    return hash_spans(units, np.cumsum(lengths) - lengths, lengths)


def _shingles(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-16 units of a text of terms, and begin and length of its three-term shingles (of the terms if fewer than three)."""
    units = np.frombuffer(" ".join(tokens).encode("utf-16-le", "surrogatepass"), dtype="<u2")
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    if sizes.sum() + len(tokens) - 1 != len(units):  # characters of two units
        sizes = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in tokens], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    width = 3 if len(tokens) >= 3 else 1
    starts = (ends - sizes)[: len(tokens) - width + 1]
    return units, starts, ends[width - 1 :] - starts


def simhashes_of(texts: Sequence[list[str]]) -> list[int]:
    """64 majority bits over the hashes of the shingles of each text of terms, signed; 0 without terms. All texts are hashed together."""
    spans = [_shingles(tokens) if tokens else (np.zeros(0, "<u2"), *[np.zeros(0, np.int64)] * 2) for tokens in texts]
    if not spans:
        return []
    units, starts, lengths = zip(*spans)
    at = np.cumsum([0, *map(len, units)])
    hashes = hash_spans(np.concatenate(units).astype(np.uint64), np.concatenate([s + a for s, a in zip(starts, at)]), np.concatenate(lengths))
    out, ends = [], np.cumsum([0, *map(len, starts)])
    for own in (hashes[a:b] for a, b in zip(ends, ends[1:])):
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(bits * 2 > len(own), bitorder="little").view(np.int64)[0]) if len(own) else 0)
    return out


def simhash_of(tokens: list[str] | np.ndarray | None) -> int:
    """``simhashes_of`` one text."""
    return simhashes_of([list(tokens) if tokens is not None else []])[0]


_simhash_udf = per_value("bigint", simhash_of)


def simhash(tokens: Column | str) -> Column:
    """SimHash of a term array, as a BIGINT of the same 64 bits; 0 for null."""
    return F.coalesce(_simhash_udf(tokens), F.lit(0).cast("bigint"))


def text_simhash(text: Column | str) -> Column:
    """``simhash`` of the terms of a text, which never leave the worker; null for null."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), TOGETHER):
            some = texts.slice(at, TOGETHER).to_pylist()
            hashes = simhashes_of([text_terms(t or "") for t in some])
            out += [None if t is None else h for t, h in zip(some, hashes)]
        return pa.array(out, pa.int64())

    return F.arrow_udf(run, "bigint")(_col(text))


def hamming(a: Column | str, b: Column | str) -> Column:
    """How many bits two hashes differ in."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))

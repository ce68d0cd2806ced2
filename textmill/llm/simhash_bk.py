"""SimHash near-duplicates with BK-trees.

Fingerprints: 64 majority bits over the XXH64 hashes of a text's word shingles.
Two fingerprints link when at most ``radius`` bits differ. Exact copies share
one fingerprint, so the search runs over distinct fingerprints only.

Search: if at most r of 64 bits differ, then of ``blocks`` bit blocks at least
``blocks - r`` agree, so linked fingerprints meet in the shard of some choice of
``agree`` agreeing blocks. Each shard is a BK-tree, children keyed by their
Hamming distance to the parent; a search follows only edges within the radius
of its own distance, and passes over a subtree that is already in the
searcher's component. That keeps tight groups of near copies cheap while every
link between different components is found. A shard over ``shard_rows`` rows is
split in chunks, each pair of chunks a tree of its own.

The trees are built where their shard lies rather than broadcast: together
they hold every fingerprint, which has no size bound.

``drop_near_duplicates`` asks for a word-shingle similarity instead of a bit
distance. Its fingerprints are those of the distinct shingles, so that a line
repeated many times in one copy counts once, as it does in the similarity. At a
similarity of 0.8 they differ in 10 bits, give or take 3 (12 for texts of four
and five shingles), where bit blocks no longer select; its shards are therefore
keyed by MinHash bands of the same shingles, its trees use a radius of 28, and
every hit is settled by the exact Jaccard similarity of the shingle sets. The
first bands find almost all links; of the shards of the other bands only those
that hold several components are searched, since the rest can link nothing new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import fresh_name, join_hot, narrow_batches, shuffle_partitions, written
from textmill.llm.components import components
from textmill.llm.grouped import runs

SLICE = 1 << 16


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a whole text as an unsigned integer; 0 when it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        hashes = np.fromiter([h(joined[a:b], seed) for a, b in zip(starts[lo:hi], stops[lo:hi])], dtype=np.uint64, count=hi - lo)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 4, seed: int = 42) -> DataFrame:
    """Append the fingerprint as a signed BIGINT of the same 64 bits."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(at)
            fps = np.fromiter((simhash(t.as_py(), shingle, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names, out])

    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])
    return docs.mapInArrow(batches, schema)


class BKTree:
    """A BK-tree over integers that links components as values are added."""

    __slots__ = ("values", "children", "parent", "whole", "radius", "same")

    def __init__(self, radius: int, same: Callable[[int, int], bool] | None = None):
        self.radius = radius
        self.same = same  # a further test of two node numbers within the radius
        self.values: list[int] = []
        self.children: list[dict[int, int] | None] = []
        self.parent: list[int] = []  # union-find over node numbers
        self.whole: list[int] = []  # a node of the one component below here, or -1 when there are several

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, value: int) -> None:
        """Insert ``value`` and join it with every component that has a value within the radius."""
        me = len(self.values)
        self.values.append(value)
        self.children.append(None)
        self.parent.append(me)
        self.whole.append(me)
        if not me:
            return
        values, children, whole, radius = self.values, self.children, self.whole, self.radius
        root, stack = me, [0]
        while stack:
            at = stack.pop()
            if root != me and whole[at] >= 0 and self.find(whole[at]) == root:
                continue
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                other = self.find(at)
                if other != root and (self.same is None or self.same(me, at)):
                    self.parent[root] = other
                    root = other
            below = children[at]
            if below:
                stack += [c for e, c in below.items() if d - radius <= e <= d + radius]
        at = 0
        while True:
            if whole[at] >= 0 and self.find(whole[at]) != root:
                whole[at] = -1
            d = (value ^ values[at]).bit_count()
            below = children[at]
            if below is None:
                children[at] = {d: me}
                return
            nxt = below.get(d)
            if nxt is None:
                below[d] = me
                return
            at = nxt


def _layout(n: int, radius: int) -> tuple[int, int]:
    """(blocks, agree): finer shards for more fingerprints; every choice finds all links."""
    if n <= 2_000_000:
        return radius + 1, 1
    return (radius + 2, 2) if n <= 500_000_000 else (radius + 3, 3)


#: Shingles of the texts of a chunk, 8 bytes each, however many texts that makes.
CHUNK_SHINGLES = 2_000_000


def _in_chunks(dealt: DataFrame, shard_rows: int, node: str, weight: str | None = None) -> DataFrame:
    """Rows of shards (way, key) with two rows or more, a large shard split so that each pair of its chunks meets as (i, j).

    Large is a shard over ``shard_rows`` rows, or over CHUNK_SHINGLES of ``weight``.
    """
    size = F.count(F.lit(1)) / F.lit(shard_rows)
    if weight:
        size = F.greatest(size, F.sum(weight) / F.lit(CHUNK_SHINGLES))
    counts = dealt.groupBy("way", "key").agg(F.count(F.lit(1)).alias("m"), F.ceil(size).cast("int").alias("g")).where(F.col("m") > 1).drop("m")
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    return (
        dealt.join(counts, ["way", "key"])
        .withColumn("c", F.pmod(F.xxhash64(node), F.col("g")).cast("int"))
        .select(*dealt.columns, F.explode(pairs).alias("p"))
        .select(*dealt.columns, "p.i", "p.j")
    )


def link_fingerprints(fps: DataFrame, radius: int = 4, shard_rows: int = 2048) -> DataFrame:
    """Links ``(a, b)`` that span the components of distinct fingerprints ``fps(fp)``."""
    spark = fps.sparkSession
    blocks, agree = _layout(fps.count(), radius)
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = []
    for chosen in combinations(range(blocks), agree):
        mask = sum(((1 << int(edges[b + 1])) - (1 << int(edges[b]))) for b in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    shards = F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(shards).alias("s")).select("fp", "s.way", "s.key")
    tasks = _in_chunks(dealt, shard_rows, "fp")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in runs(it, ["way", "key", "i", "j"]):
            values = group.column("fp").to_pylist()
            tree = BKTree(radius)
            for v in values:
                tree.add(v & 0xFFFFFFFFFFFFFFFF)
            head: dict[int, int] = {}
            for k, v in enumerate(values):
                first = head.setdefault(tree.find(k), v)
                if first != v:
                    a.append(first)
                    b.append(v)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["way", "key", "i", "j"]
    return tasks.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    Null and blank texts have fingerprint zero, which links like any other.
    Repeated rows and exact copies (ties) share their fingerprint and component;
    texts of any length are read whole. A null id belongs to its component and never names it, unless all of its ids
    are null. An empty table gives no rows; other columns, whatever their names,
    play no part.
    """
    rows = written(with_fingerprint(narrow_batches(docs, id_col, text_col).toDF("doc_id", "text"), shingle=shingle).select("doc_id", "fp"), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    comps = components(link_fingerprints(least.select("fp"), radius))
    named = written(least.join(comps, least["fp"] == comps["node"], "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("comp")), "classes")
    heads = written(named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("of")), "heads")
    by_fp = written(join_hot(named, heads, ["comp"], "of").select("fp", "n", "component_id"), "classes")
    return join_hot(rows, by_fp, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of pairs at exactly 0.8, 0.36 ** 14 = 6e-7 meet in no band.
BANDS, ROWS, FIRST_BANDS = 14, 2, 4
_MULTIPLIERS = np.random.default_rng(7).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted; empty when it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((h(b" ".join(words[k : k + shingle]), seed) for k in range(n)), dtype=np.uint64, count=n))


def set_fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits over a shingle set, each shingle counted once; 0 for an empty one."""
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), SLICE):
        votes += np.unpackbits(hashes[lo : lo + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def minhash_bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key per band of a shingle set; none for an empty one."""
    if not len(hashes):
        return []
    least = [int(((hashes ^ (hashes >> np.uint64(31))) * m).min()) for m in _MULTIPLIERS]
    keys = [xxhash.xxh64_intdigest(repr((b, least[b * ROWS : (b + 1) * ROWS])).encode()) for b in range(BANDS)]
    return [k - (1 << 64) if k >= 1 << 63 else k for k in keys]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; 0 when both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def near_components(docs: DataFrame, shingle: int = 5, radius: int = 28, similarity: float = 0.8, shard_rows: int = 2048) -> DataFrame:
    """Components of ``docs(row, text)``, row a unique BIGINT, linked at ``similarity`` or more: ``(node, component)``, linked rows only."""
    spark = docs.sparkSession

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps, bands, sizes = [], [], []
            for t in batch.column("text"):
                hashes = shingle_set(t.as_py(), shingle)
                fps.append(set_fingerprint(hashes))
                bands.append(minhash_bands(hashes))
                sizes.append(len(hashes))
            fp = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fp), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["row", "fp", "n", "bands"])

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.binary())], names=["row", "shingles"])

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(it, ["way", "key", "i", "j"]):
            rows, values = group.column("row").to_pylist(), group.column("fp").to_pylist()
            held = group.column("shingles")
            of = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in held]
            size = [len(x) for x in of]

            def same(x: int, y: int) -> bool:
                if min(size[x], size[y]) < similarity * max(size[x], size[y]) - 1e-6:  # sizes alone rule it out
                    return False
                return jaccard(of[x], of[y]) >= similarity

            tree = BKTree(radius, same)
            for v in values:
                tree.add(v & 0xFFFFFFFFFFFFFFFF)
            head: dict[int, int] = {}
            links = [(first, r) for k, r in enumerate(rows) if (first := head.setdefault(tree.find(k), r)) != r]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    def links_of(dealt: DataFrame) -> DataFrame:
        by = ["way", "key", "i", "j"]
        tasks = written(_in_chunks(dealt, shard_rows, "row", "n").drop("n"), "shards")
        wanted = tasks.select("row").distinct()
        with_sets = docs.select("row", "text").join(wanted, "row", "left_semi").mapInArrow(sets, "row long, shingles binary")
        joined = tasks.join(with_sets, "row").select("row", "fp", *by, "shingles")
        return joined.repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(search, "a long, b long")

    marked = written(docs.select("row", "text").mapInArrow(keys, "row long, fp long, n long, bands array<long>"), "bands")
    dealt = marked.select("row", "fp", "n", F.posexplode("bands").alias("way", "key"))
    found = components(links_of(dealt.where(F.col("way") < FIRST_BANDS)))
    later = dealt.where(F.col("way") >= FIRST_BANDS)
    known = later.join(found, F.col("row") == F.col("node"), "left").select("way", "key", F.coalesce("component", "row").alias("comp"))
    several = known.groupBy("way", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") < F.col("hi"))
    links = written(links_of(later.join(several.select("way", "key"), ["way", "key"], "left_semi")), "later")
    if links.isEmpty():
        return found
    return components(links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 28, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, all its columns unchanged.

    Two documents link at a Jaccard similarity of ``similarity`` or more of
    their distinct ``shingle``-word shingles (A-Z lower-cased; a shorter text is
    one shingle). Of a group the smallest id stays, and of repeated rows of it
    one. Null texts and texts without words link with nothing and stay; texts of
    any length count whole; an empty table gives none back; clashing names of
    other columns stay as they are.
    """
    scan = written(docs.withColumn(fresh_name(docs, "row_no"), F.monotonically_increasing_id()), "numbered")
    no = scan.columns[-1]
    base = scan.select(F.col(f"`{no}`").alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    comps = written(near_components(base, shingle, radius, similarity), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    members = written(base.select("row", "doc_id").join(comps, F.col("row") == F.col("node")), "members")
    stay = written(members.groupBy("component").agg(first, F.count(F.lit(1)).alias("n")).select("component", "n", F.col("first.row").alias("stays")), "stay")
    gone = join_hot(members, stay, ["component"], "n").where(F.col("row") != F.col("stays")).select(F.col("row").alias(no))
    return scan.join(gone, no, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

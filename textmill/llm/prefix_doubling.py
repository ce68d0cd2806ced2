"""Removal of repeated byte strings by distributed prefix doubling.

Whether the string of ``need`` bytes at a position also starts earlier is told
by its rank among all such strings. Ranks of short prefixes come from a Spark
sort; at growing offsets the pairs (rank here, rank at the offset) are sorted
and reranked until the prefix has ``need`` bytes, and a position whose prefix
is already unique leaves. Every sort also orders by place, so that a string
which everybody shares is spread over many tasks; what continues across a
border of tasks is told by one row per task.

Most positions never need a rank. Two narrowing steps come first, both without
loss. A string of ``need`` bytes is assigned to the gram of ``GRAM`` bytes
inside it whose hash is least; equal strings agree in it, so runs of positions
whose gram is found nowhere else are unique. Runs that agree in their gram and
in all bytes from the first to the end of the last string repeat as a whole:
all but the earliest are settled at once. The rest is cut in pieces of
``PIECE`` positions, aligned at the gram, which settle the same way; what then
still has a gram with several contexts is ranked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.common import dropped, narrow_batches, released, shuffle_partitions, written
from textmill.operators.numbering import ranked

GRAM, WORD, PIECE, AT_ONCE = 50, 32, 8, 1 << 17
_A, _B, _HALF = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157), np.uint64(31)
_LETTERS = np.random.default_rng(11).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What becomes of a run: its gram's representative in this batch, settled as repeated, still open.
ASKS, REPEATED, OPEN = 0, 1, 2
RUN = "kind int, h long, c long, doc long, at int, n int, many boolean"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _A
    h ^= b * _B
    h ^= h >> _HALF
    return h


def gram_hashes(x: np.ndarray, width: int = GRAM, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``WORD`` and of every ``width`` bytes of ``x`` (``WORD`` to twice as many), from those of halves."""
    h, k = _LETTERS[lane][x], 1
    while k < WORD:
        h, k = _mix(h[:-k], h[k:]), 2 * k
    return h, _mix(h[: len(x) - width + 1], h[width - WORD : len(x) - WORD + 1])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    m, k = v, 1
    while 2 * k <= width:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    return np.minimum(m[: len(v) - width + 1], m[width - k : len(v) - k + 1])


def range_hashes(h: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of byte ranges of ``length`` (``WORD`` at least) from the hashes ``h`` of every ``WORD`` bytes."""
    width = WORD
    out = _mix(_mix(h[first], h[first + length - width]), length.astype(np.uint64))
    long = np.flatnonzero(length > 2 * width)
    steps = (length[long] - 1) // width - 1  # between the first and the last
    owner = np.repeat(long, steps)
    offset = width * (np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps) + 1)
    np.bitwise_xor.at(out, owner, _mix(h[first[owner] + offset], offset.astype(np.uint64)))
    return _mix(out, out >> _HALF)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string or binary column without nulls, end to end, and where each starts."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs_of(x: np.ndarray, starts: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(which text, first position, number, gram, context)`` of the runs of positions with the same gram."""
    span, ends = need - GRAM + 1, starts[1:]
    for lo in range(0, len(x), AT_ONCE):
        hi = min(lo + AT_ONCE, len(x) - need + 1)  # positions lo..hi-1
        if hi <= lo:
            break
        part = x[lo : hi + need - 1]
        words, grams = gram_hashes(part)
        least = sliding_min(grams, span)
        cut = np.ones(len(least), dtype=bool)  # the first of several least grams counts: after it, or at a new one, a run begins
        cut[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
        cut[starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - lo] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], hi - lo) - 1
        text = np.searchsorted(starts, first + lo, "right") - 1
        n = np.minimum(last, ends[text] - need - lo) - first + 1
        keep = n > 0
        first, n, text = first[keep], n[keep], text[keep]
        c = range_hashes(words, first, n + need - 1)
        yield text, first + lo - starts[text], n, least[first].view(np.int64), c.view(np.int64)


def settle(doc: np.ndarray, at: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What one batch alone tells of its runs: kinds, and for representatives whether their gram has several contexts here."""
    kind, several = np.full(len(h), ASKS, dtype=np.int32), np.zeros(len(h), dtype=bool)
    order = np.argsort(h)
    again = h[order][1:] == h[order][:-1]
    order = order[np.append(again, False) | np.append(False, again)] if len(h) else order  # most grams are alone
    if len(order):
        order = order[np.lexsort((at[order], doc[order], c[order], h[order]))]
        new_h, new_c = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
        new_h[1:] = h[order][1:] != h[order][:-1]
        new_c[1:] = new_h[1:] | (c[order][1:] != c[order][:-1])
        kind[order] = np.where(new_h, ASKS, np.where(new_c, OPEN, REPEATED))
        several[order] = (np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_h)) > 1)[np.cumsum(new_h) - 1]
    return kind, several


def _told(rows: DataFrame, *kept: str) -> DataFrame:
    """Runs as settled over all batches: ``kind`` REPEATED or OPEN; those whose gram is found nowhere else leave.

    A batch sends one representative of a gram, so no gram has more rows than there are batches.
    """
    grams, same = Window.partitionBy("kind", "h"), Window.partitionBy("kind", "h", "c").orderBy("doc", "at")
    asks = F.col("kind") == ASKS
    met = rows.withColumn("contexts", F.when(asks, (F.min("c").over(grams) != F.max("c").over(grams)) | F.max("many").over(grams)))
    met = met.withColumn("rows", F.when(asks, F.count(F.lit(1)).over(grams))).where(~asks | (F.col("rows") > 1) | F.col("contexts"))
    met = met.withColumn("place", F.when(asks, F.row_number().over(same)))
    kind = F.when(~asks, F.col("kind")).when(F.col("place") > 1, F.lit(REPEATED)).when(F.col("contexts"), F.lit(OPEN))
    return met.select(kind.alias("kind"), "doc", "at", "n", *kept).where(F.col("kind").isNotNull())


def _find_runs(texts: DataFrame, need: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            docs = batch.column("doc").to_numpy()
            x, starts = bytes_of(batch.column("text"))
            found = list(runs_of(x, starts, need))
            if not found:
                continue
            text, at, n, h, c = (np.concatenate(cols) for cols in zip(*found))
            doc = docs[text]
            kind, many = settle(doc, at, h, c)
            # repeated runs that touch become one
            more = (kind == REPEATED) & np.append(False, (kind[:-1] == REPEATED) & (text[1:] == text[:-1]) & (at[:-1] + n[:-1] == at[1:]))
            n = np.add.reduceat(n, np.flatnonzero(~more))
            kind, many, doc, at, h, c = (v[~more] for v in (kind, many, doc, at, h, c))
            h = np.where(kind == ASKS, h, h ^ (at * 0x9E3779B97F4A7C1 + doc))  # the others only pass through
            columns = [kind, h, c, doc, at.astype(np.int32), n.astype(np.int32), many]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["kind", "h", "c", "doc", "at", "n", "many"])

    return texts.select("doc", "text").mapInArrow(run, RUN)


def _find_pieces(texts: DataFrame, need: int) -> DataFrame:
    """The open runs of each text, ``open`` ARRAY<STRUCT<at, n>>, in pieces aligned at their gram, with their bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, starts = bytes_of(batch.column("text"))
            spans = batch.column("open")
            which = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            at, n = flat.field("at").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            if not len(at):
                continue
            for lo in range(0, len(at), 4096):
                some = slice(lo, lo + 4096)
                mine, owner, step, place, size, h, c = _pieces_of(x, starts[which[some]], at[some], n[some], need)
                doc, first = batch.column("doc").to_numpy()[which[some][owner]], at[some][owner] + step
                kind, many = settle(doc, first, h, c)
                h = np.where(kind == ASKS, h, h ^ (first * 0x9E3779B97F4A7C1 + doc))
                raw = mine.tobytes()
                body = [None if k == REPEATED else raw[p : p + s + need - 1] for k, p, s in zip(kind.tolist(), place.tolist(), size.tolist())]
                columns = [kind, h, c, doc, first.astype(np.int32), size.astype(np.int32), many]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(body, pa.binary())], names=["kind", "h", "c", "doc", "at", "n", "many", "body"])

    return texts.select("doc", "text", "open").mapInArrow(run, RUN + ", body binary")


def _pieces_of(x: np.ndarray, base: np.ndarray, at: np.ndarray, n: np.ndarray, need: int) -> tuple[np.ndarray, ...]:
    """``(bytes, which run, position in it, place in bytes, number, key, context)`` of the pieces of runs; ``base`` is where their texts start in ``x``.

    A position's distance to its gram (the first of those with the least hash)
    says which piece it falls in, so equal strings fall in pieces of one key.
    """
    length = n + need - 1
    begin = np.cumsum(length) - length  # of each run in a buffer of their bytes
    mine = x[np.arange(length.sum()) + np.repeat(base + at - begin, length)]
    words, g = gram_hashes(mine)
    least = sliding_min(g, need - GRAM + 1)[begin]
    hits = np.flatnonzero(g == np.repeat(least, length)[: len(g)])
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    gram = hits[np.searchsorted(hits, begin[owner] + step)]
    block = (gram - begin[owner] - step) // PIECE
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]) | (gram[1:] != gram[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(owner)))
    owner, step = owner[head], step[head]
    place = begin[owner] + step
    c = range_hashes(words, place, size + need - 1)
    key = _mix(least[owner], block[head].astype(np.uint64))
    return mine, owner, step, place, size, key.view(np.int64), c.view(np.int64)


def levels(need: int) -> tuple[int, list[int]]:
    """Length of the first prefix (64 bytes at most) and the offsets at which it grows to ``need``."""
    length, offsets = need, []
    while length > 2 * WORD:
        length = -(-length // 2)
    now = length
    while now < need:
        offsets.append(min(now, need - now))
        now += offsets[-1]
    return length, offsets


def _first_keys(pieces: DataFrame, need: int) -> DataFrame:
    """``k1, k2, doc, at, rounds``: the 128-bit name of the first prefix of every position that a rank is asked of.

    ``rounds`` is the last round that needs it: all of them where a string of
    ``need`` bytes starts, fewer where only a part of one does. ``pieces`` lie
    sorted by text and place; one text at a time is complete in a task.
    """
    length, offsets = levels(need)

    def keyed(rows: pa.Table) -> pa.RecordBatch:
        doc, at, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc", "at", "n"))
        x, starts = bytes_of(rows.column("body").combine_chunks())
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rounds = np.full(len(step), len(offsets))
        for k in range(len(offsets), 0, -1):
            owner, step = np.tile(owner, 2), np.concatenate((step, step + offsets[k - 1]))
            rounds = np.concatenate((rounds, np.full(len(rounds), k - 1)))
        place = at[owner] + step
        text = np.cumsum(np.append(True, doc[1:] != doc[:-1]))[owner]
        order = np.lexsort((-rounds, place, text))
        owner, step, rounds, place, text = (v[order] for v in (owner, step, rounds, place, text))
        once = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
        owner, step, rounds, place = owner[once], step[once], rounds[once], place[once]
        names = [gram_hashes(x, length, lane)[1][starts[owner] + step].view(np.int64) for lane in (0, 1)]
        columns = [*names, doc[owner], place.astype(np.int32), rounds.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["k1", "k2", "doc", "at", "rounds"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the last text waits until it is complete
        for batch in it:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            doc = rows.column("doc").to_numpy()
            cut = int(np.searchsorted(doc == doc[-1], True)) if doc[0] != doc[-1] else 0
            if cut or (held and held[-1].column("doc")[-1].as_py() != doc[0]):
                done = pa.concat_tables([*held, rows.slice(0, cut)])
                held = []
                yield keyed(done)
            held.append(rows.slice(cut))
        if held:
            yield keyed(pa.concat_tables(held))

    return pieces.select("doc", "at", "n", "body").mapInArrow(run, "k1 long, k2 long, doc long, at int, rounds int")


def reranked(pairs: DataFrame, label: str) -> DataFrame:
    """``doc, at, rounds, rank, single, first`` of rows ``(k1, k2, doc, at, rounds)``, sorted by pair, then place.

    Equal pairs share a rank; ``first`` is the earliest row of a rank, which is
    ``single`` if it is the only one. A pair may go on over any number of
    tasks: each shows the pairs of its first and last row.
    """
    keys, carried = ["k1", "k2"], ["doc", "at", "rounds"]

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, head = TaskContext.get().partitionId(), 0, 0

        def out(cols: dict[str, np.ndarray], n: int, rank: np.ndarray, first: np.ndarray, single: np.ndarray, edges: list[int]) -> pa.RecordBatch:
            inner = np.ones(n, dtype=bool)
            inner[edges] = False
            arrays = [pa.array(np.full(n, task, np.int32)), *[pa.array(cols[k][:n], mask=inner) for k in keys], *[pa.array(cols[c][:n]) for c in carried]]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(rank[:n] + (task << 40)), pa.array(first[:n]), pa.array(single[:n])], names=["part", *keys, *carried, "rank", "first", "single"])

        rest: dict[str, np.ndarray] | None = None  # the last row waits for the next, which tells whether it is single
        rest_new = False
        for batch in it:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy() for c in (*keys, *carried)}
            if rest is not None:
                cols = {c: np.concatenate((rest[c], cols[c])) for c in cols}
            n = len(cols["doc"])
            new = np.ones(n, dtype=bool)
            new[1:] = (cols["k1"][1:] != cols["k1"][:-1]) | (cols["k2"][1:] != cols["k2"][:-1])
            new[0] = new[0] if rest is None else rest_new
            rank = np.maximum.accumulate(np.where(new, np.arange(n) + seen, head))
            single = np.zeros(n, dtype=bool)
            single[:-1] = new[:-1] & new[1:]
            if n > 1:
                yield out(cols, n - 1, rank, new, single, [] if seen else [0])
            rest, rest_new = {c: v[-1:] for c, v in cols.items()}, bool(new[-1])
            head, seen = int(rank[-1]), seen + n - 1
        if rest is not None:
            yield out(rest, 1, np.array([head]), np.array([rest_new]), np.array([rest_new]), [0])

    schema = "part int, k1 long, k2 long, doc long, at int, rounds int, rank long, first boolean, single boolean"
    rows = released(pairs.select(*keys, *carried).orderBy(*keys, "doc", "at").mapInArrow(number, schema), label)
    edges: dict[int, list] = {}
    for row in rows.where(F.col("k1").isNotNull()).select("part", "rank", "first", *keys).orderBy("rank", F.col("first").desc()).collect():
        edges.setdefault(row.part, []).append(row)
    moved, goes_on, before = {}, set(), None
    for part in sorted(edges):
        lo, hi = edges[part][0], edges[part][-1]
        if before is not None and before[0] == (lo.k1, lo.k2):
            moved[lo["rank"]] = before[1]
            goes_on |= {lo["rank"], before[1]}
        before = ((hi.k1, hi.k2), moved.get(hi["rank"], hi["rank"]))
    told = rows.select("rank", *carried, "single", "first")
    if not goes_on:
        return told.select(*carried, "rank", "single", "first")
    # what began in an earlier task has its rank from there and no first row here; one row per task at most
    fix = pairs.sparkSession.createDataFrame([(r, moved.get(r, r), r in moved) for r in sorted(goes_on)], "rank long, true_rank long, later boolean")
    told = told.join(F.broadcast(fix), "rank", "left")
    single, first = F.col("single") & F.col("true_rank").isNull(), F.col("first") & ~F.coalesce("later", F.lit(False))
    return told.select(*carried, F.coalesce("true_rank", "rank").alias("rank"), single.alias("single"), first.alias("first"))


def _ranked_repeats(pieces: DataFrame, need: int) -> DataFrame:
    """``doc, at`` of the positions in ``pieces`` whose string of ``need`` bytes starts earlier among them."""
    pairs = _first_keys(pieces, need)
    for done, offset in enumerate(levels(need)[1], 1):
        ranks = reranked(pairs, "ranks")
        shared = ranks.where(~F.col("single"))
        further = shared.select("doc", (F.col("at") - offset).alias("at"), F.col("rank").alias("k2"))
        here = shared.where(F.col("rounds") >= done).select("doc", "at", "rounds", F.col("rank").alias("k1"))
        last, pairs = pairs, released(here.join(further, ["doc", "at"]), "pairs")
        dropped(ranks)
        if done > 1:
            dropped(last)
    return reranked(pairs, "ranks").where(~F.col("first")).select("doc", "at")


def repeated_runs(texts: DataFrame, need: int = 100) -> DataFrame:
    """``doc, at, n``: runs of positions whose string of ``need`` bytes also starts at an earlier place.

    ``texts(doc BIGINT, text)``: ``doc`` is unique and in order. Runs may touch
    or repeat.
    """
    if need < 64:
        raise ValueError("strings of 64 bytes at least")
    runs = released(_told(_find_runs(texts, need)), "runs")
    open_runs = runs.where(F.col("kind") == OPEN).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("open"))
    told = _told(_find_pieces(texts.join(open_runs, "doc"), need), "body")
    pieces = released(told.repartition(shuffle_partitions(texts.sparkSession), "doc").sortWithinPartitions("doc", "at"), "pieces")
    ranks = _ranked_repeats(pieces.where(F.col("kind") == OPEN), need)
    settled = runs.unionByName(pieces.drop("body")).where(F.col("kind") == REPEATED).select("doc", "at", "n")
    return settled.unionByName(ranks.withColumn("n", F.lit(1)))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, doc_id, text``: whole, unique ids are their own numbers; else documents are numbered by id, nulls last, then text."""
    rows = narrow_batches(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    if dict(rows.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        n, known, different = rows.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
        if n == known == different:
            return rows.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    keyed = written(rows.withColumn("uid", F.monotonically_increasing_id()), "texts")
    return ranked(keyed, [F.col("doc_id").asc_nulls_last(), F.col("text"), F.col("uid")], "doc").select("doc", "doc_id", "text")


def remove_repeats(docs: DataFrame, need: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``need`` bytes that also starts earlier.

    One row per document: ``doc_id, n_bytes, n_removed, n_spans`` (maximal
    removed runs), ``kept_sha256`` and, with ``with_text``, ``kept`` BINARY (a
    cut may fall inside a character). Earlier means a smaller id, or an earlier
    start in the same document; strings are those of the input, so it does not
    matter what has been removed.

    Null texts are empty: nothing to remove. Texts of any length are handled,
    1 MB at a time. Repeated rows: ids need not be unique; equal ids are
    ordered by text, and rows that agree in both are interchangeable (the first
    keeps its text). Null ids come last. An empty table gives no rows; other
    columns play no part.
    """
    texts = numbered(docs, id_col, text_col)
    runs = repeated_runs(texts, need).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    id_type = dict(texts.dtypes)["doc_id"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, starts = bytes_of(batch.column("text"))
            removed, spans, digests, kept = [], [], [], []
            for k, found in enumerate(batch.column("runs")):
                body = x[starts[k] : starts[k + 1]]
                gone = None
                if found.is_valid:
                    at, n = found.values.field("at").to_numpy(), found.values.field("n").to_numpy()
                    change = np.zeros(len(body) + 1, dtype=np.int32)
                    np.add.at(change, at, 1)
                    np.add.at(change, at.astype(np.int64) + n + need - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    body = body[~gone]
                removed.append(0 if gone is None else int(gone.sum()))
                spans.append(0 if gone is None else int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    kept.append(body.tobytes())
            arrays = [batch.column("doc_id"), pa.array(np.diff(starts)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.binary())] if with_text else []), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return texts.join(runs, "doc", "left").select("doc_id", "text", "runs").mapInArrow(run, schema)

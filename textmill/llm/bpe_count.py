"""Token counts by byte-pair merging with a heap over a linked list.

A piece of text starts as one symbol per byte; the adjacent pair of lowest
rank is popped and merged until no pair is known. The count is the number of
initial symbols minus the number of merges; identifiers are never made.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import narrow_batches

#: White space as Unicode has it, spelled out: libraries differ on 1C to 1F.
_S = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Pieces of the byte-level scheme: clitics, letters, digits, other signs, white space.
PIECES = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
REMEMBERED_BYTES = 48
REMEMBERED_PIECES = 300_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class PairCounter(dict):
    """``piece -> tokens``, a dictionary that works out what it lacks; bounded in size."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        self.symbols = [number(c) for c in byte_alphabet()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((number(left), number(right)), (rank, number(left + right)))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def merged(self, data: bytes) -> int:
        """Symbols left after all merges."""
        symbol = [self.symbols[b] for b in data]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, count = self.pairs, n
        heap = []
        for i in range(n - 1):
            known = pairs.get((symbol[i], symbol[i + 1]))
            if known:
                heap.append((known[0], i, symbol[i], symbol[i + 1], known[1]))
        heapify(heap)
        while heap:
            _, i, left, right, new = heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                known = pairs.get((new, symbol[k]))
                if known:
                    heappush(heap, (known[0], i, new, symbol[k], known[1]))
            h = before[i]
            if h >= 0:
                known = pairs.get((symbol[h], new))
                if known:
                    heappush(heap, (known[0], h, symbol[h], new, known[1]))
        return count

    def __missing__(self, piece: str) -> int:
        data = piece.encode("utf-8", "surrogatepass")
        count = self.merged(data)
        if len(data) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = count
        return count

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, PIECES.findall(text)))

    def tokens(self, text: str | None) -> int:
        """Tokens of a whole text; a special token's string inside it is one token."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@lru_cache(maxsize=4)
def counter(path: str) -> PairCounter:
    """One counter per worker process and vocabulary."""
    return PairCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``vocabulary``: path of a byte-level BPE file on every executor. Null texts
    are empty: 0 bytes, 0 tokens. Rows are independent: repeated rows and null
    ids come back as they are, an empty table gives none, other columns play no
    part. Whole texts are read, however long.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary).tokens
        for batch in it:
            n = np.fromiter((tokens(t.as_py()) for t in batch.column("text")), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = narrow_batches(docs, id_col, text_col).toDF("doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. Whole windows of a long
document leave at once; what remains of it goes to the open window it fits
best. When none fits and no further one may be opened, the fullest is topped
up with the head of the document and emitted. At the end the leftover windows
of the partition are merged end to end, and the last incomplete one is cut at
powers of two, the lengths that need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textmill.llm.bpe_count import byte_alphabet
from textmill.llm.common import narrow_batches

#: Fixed by the vocabulary's file: clitics, letters, single digits, other signs.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters on which all Unicode versions and libraries agree; texts with others go to the library whole.
_PLAIN = regex.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa0-įı-ɏ‐-‧]*")
REMEMBERED_CHUNKS = 250_000


class WordIds(dict):
    """``run of text without white space -> packed ids``, filled by the tokenizer library; bounded in size."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        #: the shortcut is for word-end vocabularies that fold case, drop white space and split as _WORDS does
        self.model, self.letters, self.words = self.tokenizer.model, byte_alphabet(), {}
        self.before: dict[str, bytes] = {}
        self.by_words = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str().replace(" ", "")

    def word(self, word: str) -> bytes:
        """Packed ids of one word: the library's merge model over the word's byte letters."""
        packed = self.words.get(word)
        if packed is None:
            letters = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
            packed = np.array([t.id for t in self.model.tokenize(letters)], dtype="<u4").tobytes()
            if len(word) <= 40:
                if len(self.words) >= REMEMBERED_CHUNKS:
                    self.words.clear()
                self.words[word] = packed
        return packed

    def __missing__(self, chunk: str) -> bytes:
        packed = self.before.get(chunk)
        if packed is None:
            packed = b"".join(map(self.word, _WORDS.findall(chunk)))
        if len(chunk) <= 40:
            if len(self) >= REMEMBERED_CHUNKS:  # one generation back stays at hand, so that frequent runs survive
                self.before = dict(self)
                self.clear()
            self[chunk] = packed
        return packed

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text as the library gives them; each distinct run between white space is encoded once."""
        text = text or ""
        if self.by_words and _PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """The windows of one partition. A piece is ``(tag, start, ids)``; ``emit`` gets the pieces of each finished window."""

    def __init__(self, emit, size: int = 2048, windows: int = 16):
        self.emit, self.size, self.windows = emit, size, windows
        self.open: list[tuple[int, list]] = []  # (tokens left, pieces)

    def add(self, tag, ids: np.ndarray) -> None:
        start, n, size = 0, len(ids), self.size
        while n - start >= size:
            self.emit([(tag, start, ids[start : start + size])])
            start += size
        while start < n:
            rest = n - start
            fit = min((k for k, w in enumerate(self.open) if w[0] >= rest), key=lambda k: self.open[k][0], default=None)
            if fit is None and len(self.open) < self.windows:
                self.open.append((size, []))
                fit = len(self.open) - 1
            if fit is None:
                fit = min(range(len(self.open)), key=lambda k: self.open[k][0])
            left, pieces = self.open[fit]
            taken = min(left, rest)
            pieces.append((tag, start, ids[start : start + taken]))
            start += taken
            if taken == left:
                self.emit(pieces)
                self.open.pop(fit)
            else:
                self.open[fit] = (left - taken, pieces)

    def close(self) -> None:
        """Merge what is left, fullest windows first."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: w[0]) for p in pieces]
        self.open = []
        total = sum(len(p[2]) for p in rest)
        lengths = [self.size] * (total // self.size) + [1 << b for b in range(self.size.bit_length(), -1, -1) if total % self.size >> b & 1]
        for length in lengths:
            now, room = [], length
            while room:
                tag, start, ids = rest[0]
                taken = min(room, len(ids))
                now.append((tag, start, ids[:taken]))
                room -= taken
                if taken == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = (tag, start + taken, ids[taken:])
            self.emit(now)


def pack(
    docs: DataFrame,
    vocabulary: str,
    size: int = 2048,
    windows: int = 16,
    end_id: int = 1,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack whole documents, each closed by ``end_id``, into sequences of at most ``size`` tokens.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``, with ``with_ids`` also ``ids``. Every id of every
    document lies in one piece; a sequence is full or a power of two long.

    Null texts are empty: one piece that holds ``end_id``. Rows are
    independent, so repeated rows and null ids are packed each; an empty table
    gives no rows; other columns play no part.
    """
    rows = narrow_batches(docs, id_col, text_col).toDF("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary).ids
        first = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        out: list[list] = [[] for _ in names]
        made = 0

        def emit(pieces: list) -> None:
            nonlocal made
            at = 0
            for (doc_id, tokens), start, ids in pieces:
                row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, first + made, at)
                for column, value in zip(out, (*row, ids)):
                    column.append(value)
                at += len(ids)
            made += 1

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * 6, pa.list_(pa.int32())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            for column in out:
                column.clear()
            return batch

        packer, kind = Packer(emit, size, windows), None
        end = np.array([end_id], dtype=np.uint32)
        for batch in it:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.concatenate((ids_of(text.as_py()), end))
                packer.add((doc_id, len(ids)), ids)
            yield flush(kind)
        if kind is not None:
            packer.close()
            yield flush(kind)

    schema = f"doc_id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))

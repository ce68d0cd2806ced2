"""Which of many questions a text mentions, in one pass over the text.

The spellings of all keywords of all questions make one Aho-Corasick automaton
over text in lower case without accents; a task reads a document once and knows
every spelling in it. Questions come in slices whose spellings are small enough
to be told to every task; one slice is the rule. Nothing is shuffled, and pairs
of a document and a question it does not mention are never made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import build_matcher, plain_text
from textmill.operators.cuts import written

#: Bytes of spellings and their keywords that one broadcast may hold.
TOLD = 32 << 20


def question_spellings(questions: DataFrame, id_col: str, text_col: str, limit: int = 8) -> DataFrame:
    """``question, n, keyword, spelling``: the first ``limit`` keywords of every question, ``n`` of them, and what counts as each."""
    kind = questions.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [
                (q, len(m.keywords), i, plain_text(spelling))
                for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for m in [build_matcher(text or "", limit)]
                for i, k in enumerate(m.keywords)
                for spelling, _ in k.variants
            ]
            columns = zip(*rows) if rows else ([], [], [], [])
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["question", "n", "keyword", "spelling"])

    return questions.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"question {kind}, n int, keyword int, spelling string")


class Finder:
    """All spellings of some questions as one automaton, and the (question, keyword) codes that each stands for."""

    def __init__(self, spellings: list[str], owners: np.ndarray, codes: np.ndarray):
        import ahocorasick

        order = np.argsort(owners, kind="stable")
        self.codes, self.first = codes[order], np.searchsorted(owners[order], np.arange(len(spellings) + 1))
        self.automaton = ahocorasick.Automaton()
        for i, spelling in enumerate(spellings):
            self.automaton.add_word(spelling, i)
        self.automaton.make_automaton()

    def hits(self, text: str) -> np.ndarray:
        """Codes of the keywords that a text mentions, each once."""
        seen = {i for _, i in self.automaton.iter(plain_text(text))}
        return np.unique(np.concatenate([self.codes[self.first[i] : self.first[i + 1]] for i in seen])) if seen else self.codes[:0]


def coverage_of_questions(docs: DataFrame, questions: DataFrame, doc_id: str, doc_text: str, question_id: str, question_text: str, limit: int = 8, told: int = TOLD) -> DataFrame:
    """``question, doc, hits, coverage`` of every document and question it mentions a keyword of.

    ``coverage`` is the share of the question's keywords; pairs without a hit
    have no row, and so have null and empty texts and questions without
    keywords. Ids may repeat: questions count by id, so theirs should not.
    """
    spark = docs.sparkSession
    spellings = written(question_spellings(questions, question_id, question_text, limit).where("spelling <> ''"), "spellings")
    size = spellings.agg(F.coalesce(F.sum(F.octet_length("spelling") + 32), F.lit(0))).first()[0]
    slices = max(1, -(-size // told))
    narrow = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where("text is not null")
    q_type, d_type = spellings.schema["question"].dataType.simpleString(), narrow.schema["doc"].dataType.simpleString()
    schema = f"question {q_type}, doc {d_type}, hits int, coverage double"
    parts = []
    for part in range(slices):
        mine = spellings.where(F.pmod(F.xxhash64("question"), F.lit(slices)) == part).toArrow()  # a slice holds at most about `told` bytes
        if mine.num_rows:
            parts.append(_covered(narrow, mine, schema, limit))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _covered(docs: DataFrame, spellings: pa.Table, schema: str, limit: int) -> DataFrame:
    ids = spellings.column("question").combine_chunks().dictionary_encode()
    numbers = np.asarray(ids.indices)
    n = np.zeros(len(ids.dictionary), dtype=np.int64)
    n[numbers] = spellings.column("n").to_numpy()
    distinct = spellings.column("spelling").combine_chunks().dictionary_encode()
    codes = numbers.astype(np.int64) * limit + spellings.column("keyword").to_numpy()
    told = docs.sparkSession.sparkContext.broadcast((distinct.dictionary.to_pylist(), np.asarray(distinct.indices), codes))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*told.value)
        for batch in it:
            who, which, hits = [], [], []
            for k, text in enumerate(batch.column("text")):
                found, count = np.unique(finder.hits(text.as_py()) // limit, return_counts=True)
                who.append(np.full(len(found), k))
                which.append(found)
                hits.append(count)
            if who:
                w, q, h = np.concatenate(which), np.concatenate(who), np.concatenate(hits)
                yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(w)), batch.column("doc").take(pa.array(q)), pa.array(h.astype(np.int32)), pa.array(h / n[w])], names=["question", "doc", "hits", "coverage"])

    return docs.mapInArrow(run, schema)

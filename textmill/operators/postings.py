"""BM25 for many questions at once over an inverted index.

The index is a table of postings, one row per term and document, sorted by
term and block: documents of similar length lie in one block. A question's
score in a block is at most the sum of its terms' largest parts there. Its
best blocks give a first k-th score; after that only blocks whose bound
reaches it are opened, and what they hold is scored exactly. Questions meet
postings by term, never documents as such.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.cuts import dropped, released, written
from textmill.operators.ranking import NEAR, NEAR_BONUS

#: Documents of a block, and lengths of documents that are told apart.
BLOCK, LENGTHS = 64, 32


@dataclass(frozen=True)
class Postings:
    """``posts(term, block, doc, part, places)``, ``maxima(term, block, most)`` and ``terms(term, idf)`` of a pool."""

    posts: DataFrame
    maxima: DataFrame
    terms: DataFrame


def build_postings(docs: DataFrame, id_col: str, tokens_col: str, k1: float = 1.2, b: float = 0.75, block: int = BLOCK) -> Postings:
    """Index ``docs``: ids are unique, tokens an array of terms, null for none.

    ``part`` is a term's share of the score of a document before its inverse
    document frequency, ``places`` where it stands.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(tokens_col, F.array().cast("array<string>")).alias("tokens"))
    rows = written(rows.withColumn("dl", F.size("tokens")), "indexed")
    cuts = F.percentile_approx("dl", [i / LENGTHS for i in range(1, LENGTHS)], 1000)
    n, avgdl, bounds = rows.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0)), cuts).first()
    parts = max(1, -(-n // (block * LENGTHS)))
    longer = F.size(F.filter(F.array(*[F.lit(int(x)) for x in bounds or [0]]), lambda x: x < F.col("dl")))
    placed = rows.withColumn("block", (longer * parts + F.pmod(F.xxhash64("doc"), F.lit(parts))).cast("int"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"term string, block int, doc {kind}, part double, places array<int>"

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The postings of each document, side by side: no document meets another."""
        for batch in it:
            tokens = batch.column("tokens")
            lengths = np.diff(tokens.offsets.to_numpy())
            terms = tokens.flatten().dictionary_encode()
            code, row = np.asarray(terms.indices), np.repeat(np.arange(len(lengths)), lengths)
            if not len(code):
                continue
            place = (np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            key = row * len(terms.dictionary) + code
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            ends = np.append(heads, len(order)).astype(np.int32)
            f, mine = np.diff(ends).astype(float), row[order[heads]]
            norm = (1 - b) + b * (lengths[mine] / avgdl)
            columns = [terms.dictionary.take(pa.array(code[order[heads]])), batch.column("block").take(pa.array(mine)), batch.column("doc").take(pa.array(mine)), pa.array(f * (k1 + 1) / (f + k1 * norm)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order]))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "block", "doc", "part", "places"])

    # a frequent term lies in as many tasks as it has blocks
    posts = placed.select("doc", "tokens", "block").mapInArrow(gather, schema).repartition("term", "block").sortWithinPartitions("term", "block", "doc")
    posts = released(posts, "postings")
    dropped(rows)
    maxima = written(posts.groupBy("term", "block").agg(F.max("part").alias("most")), "maxima")
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.lit(1.0) if n < 3 else F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Postings(posts, maxima, written(df.select("term", idf.alias("idf")), "terms-of-index"))


def _scores(index: Postings, opened: DataFrame, asked: DataFrame) -> DataFrame:
    """``question, doc, score`` of all documents in ``opened(question, block)`` that share a term with the question."""
    posts = index.posts.join(asked.select("term").distinct(), "term", "left_semi")
    hits = opened.join(asked, "question").join(posts, ["term", "block"])
    per_doc = hits.groupBy("question", "doc", "n_terms").agg(
        F.sort_array(F.collect_list(F.struct("term", (F.col("idf") * F.col("part")).alias("v")))).alias("parts"),
        F.sort_array(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("i"), F.col("term").alias("t")))))).alias("hits"),
    )
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["v"])  # in term order, so that equal texts score equally
    later = F.slice("hits", F.lit(2), F.greatest(F.size("hits") - 1, F.lit(0)))
    close = F.zip_with("hits", later, lambda a, z: F.coalesce((a["t"] != z["t"]) & (z["i"] - a["i"] <= NEAR), F.lit(False)))
    bonus = F.least(F.lit(NEAR_BONUS), F.lit(NEAR_BONUS) * F.size(F.filter(close, lambda c: c)) / F.greatest(F.lit(1), F.col("n_terms") - 1))
    return per_doc.select("question", "doc", (total * F.when(F.col("n_terms") > 1, 1 + bonus).otherwise(1.0)).alias("score"))


def _first(rows: DataFrame, k: int, order: list[Column], out: str) -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy("question").orderBy(*order))).where(F.col(out) <= k)


def search_postings(index: Postings, questions: DataFrame, id_col: str, terms_col: str, k: int = 10, digits: int = 6) -> DataFrame:
    """The ``k`` best documents of every question: ``question, doc, score, place``.

    Scores are rounded to ``digits``; ties go by document. A question finds
    only documents that share a term with it; one without terms finds none.
    Terms may repeat in a question and count once; ids are unique.
    """
    asked = questions.select(F.col(id_col).alias("question"), F.array_distinct(terms_col).alias("ts")).withColumn("n_terms", F.size("ts"))
    asked = written(asked.select("question", "n_terms", F.explode("ts").alias("term")).join(index.terms, "term"), "asked")
    bounds = asked.join(index.maxima, "term").groupBy("question", "block").agg((F.sum(F.col("idf") * F.col("most")) * (1 + NEAR_BONUS)).alias("bound"))
    bounds = written(bounds, "block-bounds")
    start = _first(bounds, k, [F.col("bound").desc(), F.col("block")], "no").select("question", "block")
    order = [F.col("score").desc(), F.col("doc")]
    rounded = lambda rows: rows.withColumn("score", F.round("score", digits))
    kth = _first(rounded(_scores(index, start, asked)), k, order, "place").where(F.col("place") == k).select("question", F.col("score").alias("kth"))
    # half a unit of rounding and the last bit of the bound's sum must not close a block
    slack = 10.0**-digits
    opened = bounds.join(written(kth, "kth"), "question", "left").where(F.col("kth").isNull() | (F.col("bound") + slack >= F.col("kth")))
    return _first(rounded(_scores(index, opened.select("question", "block"), asked)), k, order, "place")

"""Turning a pool of candidates into a reading order.

Every relation carries its order as a column: ``pos`` for input order, ``rank``
for output. Every sort ends in a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textmill.functions.hashing import text_simhash
from textmill.functions.text import Matcher, query_terms, terms
from textmill.functions.urls import canonicalize_url
from textmill.functions.vectors import cosine
from textmill.operators.bitindex import hash_pairs
from textmill.operators.cuts import dropped, written
from textmill.operators.diversity import mmr_order, mmr_places
from textmill.operators.numbering import ranked

# Fixed values of the scorer: field weights, proximity window and its most.
TITLE_WEIGHT, HEADING_WEIGHT = 3, 2
NEAR, NEAR_BONUS = 6, 0.1
SETTLED_AT_ONCE = 100_000


def document_terms(body: Column | str, headings: Column | str | None = None, title: Column | str | None = None) -> Column:
    """The weighted term stream of a document: body once, headings twice, title three times."""
    parts = [terms(body)]
    if headings is not None:
        parts += [terms(headings)] * HEADING_WEIGHT
    if title is not None:
        parts += [terms(title)] * TITLE_WEIGHT
    return F.concat(*parts) if len(parts) > 1 else parts[0]


@dataclass(frozen=True)
class Bm25Index:
    """Statistics of a pool for one question; small enough to live in the plan as literals."""

    query_terms: tuple[str, ...]
    n: int
    avgdl: float
    idf: tuple[float, ...]
    k1: float = 1.2
    b: float = 0.75


def build_bm25_index(docs: DataFrame, question: str, tokens: str = "tokens", k1: float = 1.2, b: float = 0.75) -> Bm25Index:
    """Pool size, mean length and document frequency of each question term, in one aggregation; an empty pool is fine."""
    asked = query_terms(question)
    per_term = [F.coalesce(F.sum(F.array_contains(tokens, t).cast("long")), F.lit(0)).alias(f"df{i}") for i, t in enumerate(asked)]
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(tokens)), F.lit(0.0)).alias("avgdl"), *per_term).first()
    idf = [1.0 if row.n < 3 else float(np.log(1 + (row.n - row[f"df{i}"] + 0.5) / (row[f"df{i}"] + 0.5))) for i in range(len(asked))]
    return Bm25Index(tuple(asked), row.n, float(row.avgdl), tuple(idf), k1, b)


def bm25_score(index: Bm25Index, tokens: Column | str) -> Column:
    """Field-weighted BM25 with a bounded bonus for question terms close together. 0 for no question or no terms."""
    if not index.query_terms:
        return F.lit(0.0)
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    dl = F.size(tokens)
    places = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    hits = F.filter(places, lambda h: h["t"].isin(*index.query_terms))
    norm = F.lit(1 - index.b) + F.lit(index.b) * (dl / F.lit(index.avgdl) if index.avgdl else F.lit(1.0))

    def score(hits: Column) -> Column:
        total = F.lit(0.0)
        for term, idf in zip(index.query_terms, index.idf):
            f = F.size(F.filter(hits, lambda h: h["t"] == term)).cast("double")
            total = total + F.lit(idf) * f * F.lit(index.k1 + 1) / (f + F.lit(index.k1) * norm)
        if len(index.query_terms) < 2:
            return total
        later = F.slice(hits, F.lit(2), F.greatest(F.size(hits) - 1, F.lit(0)))
        close = F.zip_with(hits, later, lambda a, z: (a["t"] != z["t"]) & (z["i"] - a["i"] <= NEAR))
        n = F.size(F.filter(close, lambda c: F.coalesce(c, F.lit(False))))
        return total * (1 + F.least(F.lit(NEAR_BONUS), F.lit(NEAR_BONUS) * n / F.lit(max(1, len(index.query_terms) - 1))))

    # bind the hits once: the fold over a one-element array keeps them from being worked out per term
    return F.when(dl > 0, F.aggregate(F.array(hits), F.lit(0.0), lambda _, h: score(h))).otherwise(F.lit(0.0))


def bm25_matched(index: Bm25Index, tokens: Column | str) -> Column:
    """The question's terms that a document has, in question order."""
    found = [F.when(F.array_contains(tokens, t), F.lit(t)) for t in index.query_terms]
    return F.filter(F.array(*found), lambda t: t.isNotNull()) if found else F.array().cast("array<string>")


def rrf(lists: DataFrame, key: str = "key", pos: str = "pos", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``(list, pos, key)`` rows, positions from 0: ``key, score``. A key repeated inside a list counts each time."""
    return lists.groupBy(key).agg(F.sum(1.0 / (k + F.col(pos) + 1)).alias("score"))


def dedupe_by_url(items: DataFrame, url: str = "url", score: str = "score", pos: str = "pos") -> DataFrame:
    """One item per canonical address: the best-scored, first on ties; ``pos`` becomes the place of the address's first item.

    Rows without score rank last; null addresses are one address.
    """
    canon = items.withColumn("canonical_url", canonicalize_url(url))
    best = Window.partitionBy("canonical_url").orderBy(F.col(score).desc_nulls_last(), F.col(pos))
    first = F.min(pos).over(Window.partitionBy("canonical_url"))
    return canon.withColumn("_rn", F.row_number().over(best)).withColumn("_first", first).where("_rn = 1").withColumn(pos, F.col("_first")).drop("_rn", "_first")


def relevance_floor(ordered: DataFrame, asked: Sequence[str], floor: int, rank: str = "rank", matched: str = "matched") -> DataFrame:
    """Drop candidates that share no word with the question, but never below ``floor`` of them.

    Appends ``kept`` and ``place``: kept rows first in rank order, re-admitted
    ones after them. Inert unless the question has two terms, one with letters.
    Places come from a range sort over topic and ``rank``, which must be unique.
    """
    wordy = [t for t in asked if any(ch.isalpha() for ch in t)]
    if len(asked) < 2 or not wordy:
        return ranked(ordered.withColumn("kept", F.lit(True)), [F.col(rank)], "place")
    off = ~F.exists(F.coalesce(matched, F.array().cast("array<string>")), lambda t: t.rlike(r"\p{L}"))
    placed = ranked(ordered.withColumn("_off", off), [F.col("_off"), F.col(rank)], "place")
    on = placed.agg(F.count_if(~F.col("_off"))).first()[0]
    return placed.withColumn("kept", ~F.col("_off") | (F.col("place") <= max(on, floor))).drop("_off")


def recency(year: Column | str, least: Column, most: Column) -> Column:
    """Where a year lies in the pool's span, 0 to 1; 0.5 without a year or a span."""
    y = F.col(year) if isinstance(year, str) else year
    inside = F.least(most, F.greatest(least, y))
    return F.when(y.isNull() | (most <= least), F.lit(0.5)).otherwise((inside - least) / (most - least).cast("double"))


def with_recency(items: DataFrame, year: str = "year", out: str = "recency") -> DataFrame:
    """``recency`` over the whole pool; the span is aggregated once and enters as literals."""
    span = items.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).first()
    return items.withColumn(out, recency(year, F.lit(span.lo), F.lit(span.hi)) if span.lo is not None else F.lit(0.5))


def content_coverage(matcher: Matcher, text: Column | str) -> Column:
    return matcher.coverage(text)


# -- near duplicates ----------------------------------------------------------------------------


def greedy_keep(n: int, earlier: Sequence[tuple[int, int]]) -> np.ndarray:
    """Whether each of ``n`` items, best first, survives: it does if none of its earlier neighbours survives."""
    keep = np.ones(n, dtype=bool)
    neighbours: dict[int, list[int]] = {}
    for a, b in earlier:
        neighbours.setdefault(b, []).append(a)
    for b in sorted(neighbours):
        keep[b] = not any(keep[a] for a in neighbours[b])
    return keep


def _settle(pairs: Sequence[tuple[int, int, bool | None]]) -> dict[int, bool]:
    """The greedy rule for the undecided ``b`` of pairs ``(a, b, whether a survives, None for undecided)``."""
    earlier: dict[int, list[tuple[int, bool | None]]] = {}
    for a, b, survives in pairs:
        earlier.setdefault(b, []).append((a, survives))
    kept: dict[int, bool] = {}
    for b in sorted(earlier):
        kept[b] = not any(kept[a] if survives is None else survives for a, survives in earlier[b])
    return kept


def dedupe_near_duplicates(items: DataFrame, rank: str = "rank", text: str = "text", max_bits: int = 3, min_chars: int = 500, max_rounds: int = 50) -> DataFrame:
    """Collapse near copies of best-first items; shorter texts never collapse. Appends ``kept``.

    Equal hashes collapse to their best item before the join, so groups of
    copies cost one row. ``rank`` is unique. Survivors settle in rounds: an item with no undecided
    or surviving earlier neighbour survives, one with a surviving one goes.
    Each round settles one item at least; it goes on until none is undecided.
    After ``max_rounds`` rounds (a long chain of drifting copies settles few
    items a round) the rest is settled in one pass as soon as it has at most
    ``SETTLED_AT_ONCE`` pairs.
    """
    narrow = written(items.select(F.col(rank).alias("_at"), near_hash(text, min_chars).alias("_h")), "near-hashes")  # each text is read once
    told = collapse_hashes(narrow, "_at", "_h", max_bits, max_rounds).select("_at", "kept")
    return items.join(told, F.col(rank) == F.col("_at")).drop("_at")


def near_hash(text: Column | str, min_chars: int = 500) -> Column:
    """The SimHash that near copies agree in, null for texts too short to collapse."""
    text = F.col(text) if isinstance(text, str) else text
    return text_simhash(F.when(F.length(text) >= min_chars, text))


def collapse_hashes(hashed: DataFrame, rank: str, hash_col: str, max_bits: int = 3, max_rounds: int = 50) -> DataFrame:
    """``dedupe_near_duplicates`` of rows that have their hash, null for rows that never collapse. Appends ``kept``."""
    hashed = hashed.withColumn("_h", F.col(hash_col))
    heads = hashed.where(F.col("_h").isNotNull()).groupBy("_h").agg(F.min(rank).alias("head"))
    pairs = written(hash_pairs(heads, "head", "_h", max_bits).select("a", "b"), "near-pairs")
    state = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "near-state")
    for done in count(1):
        before = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a")
        seen = before.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("some"), F.bool_or(F.col("ka").isNull()).alias("open"))
        settled = F.coalesce("kept", F.when(F.coalesce("some", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True)))
        last, state = state, written(state.join(seen, "id", "left").select("id", settled.alias("kept")), "near-state")
        dropped(last)
        undecided = state.where(F.col("kept").isNull()).select("id")
        if undecided.isEmpty():
            break
        if done < max_rounds:
            continue
        rest = pairs.join(undecided.select(F.col("id").alias("b")), "b", "left_semi").join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a")
        rest = written(rest.select("a", "b", "ka"), "near-rest")
        if rest.count() <= SETTLED_AT_ONCE:
            last = _settle([(r.a, r.b, r.ka) for r in rest.collect()])
            told = hashed.sparkSession.createDataFrame(list(last.items()), T.StructType([T.StructField("id", state.schema["id"].dataType), T.StructField("last", T.BooleanType())]))
            state = state.join(F.broadcast(told), "id", "left").select("id", F.coalesce("kept", "last").alias("kept"))
            break
    gone = state.where(~F.col("kept")).select(F.col("id").alias("head"), F.lit(True).alias("_gone"))
    stays = heads.join(gone, "head", "left").select(F.col("_h"), F.when(F.col("_gone").isNull(), F.col("head")).alias("_stay"))
    joined = hashed.join(stays, "_h", "left")
    return joined.withColumn("kept", F.col("_h").isNull() | F.coalesce(F.col(rank) == F.col("_stay"), F.lit(False))).drop("_stay", *(["_h"] if hash_col != "_h" else []))


# -- diversity ----------------------------------------------------------------------------------


def diversify(items: DataFrame, tokens: str = "tokens", score: str = "score", url: str = "url", pos: str = "pos", group: str | None = None, weight: float = 0.75) -> DataFrame:
    """Reorder so that the top says different things: appends ``place`` from 1; every row comes back once.

    With ``group``, each group is the candidate pool of one question, which
    fits a task by intent; pools of two or fewer keep their order by ``pos``.
    Without, all rows are one pool of any size. Null tokens are an empty set.
    """
    items = items.withColumn(tokens, F.coalesce(tokens, F.array().cast("array<string>")))
    if group is None:
        numbered = written(items.withColumn("_row", F.monotonically_increasing_id()), "items")
        if numbered.count() <= 2:
            return ranked(numbered, [F.col(pos), F.col("_row")], "place").withColumn("place", F.col("place").cast("int")).drop("_row")
        words = F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))
        places = mmr_places(numbered.select(F.col("_row").alias("row"), F.col(url).alias("url"), F.col(score).alias("score"), words.alias("words")), weight=weight)
        return numbered.join(places.select(F.col("row").alias("_row"), F.col("place").cast("int").alias("place")), "_row").drop("_row")
    schema = T.StructType([*items.schema.fields, T.StructField("place", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        order = mmr_order(pdf[score].to_numpy(float), [set(t) for t in pdf[tokens]], pdf[url].tolist(), weight)
        place = np.empty(len(pdf), dtype=np.int32)
        place[order] = np.arange(1, len(pdf) + 1)
        return pdf.assign(place=place)

    return items.groupBy(group).applyInPandas(run, schema)


# -- the whole pipeline -------------------------------------------------------------------------


def rank_documents(docs: DataFrame, question: str, limit: int | None = None) -> DataFrame:
    """The flagship: rank ``docs(url, title, headings, text)`` for a question.

    BM25F, near copies collapsed, the rest diversified: ``rank, url, title,
    score, matched``, score to 4 digits. Every document that is no near copy of
    a better one takes part; with ``limit`` only the first so many are told,
    and only blocks that may hold them are compared. Statistics cover all
    documents. A question without terms gives no rows, and so does an empty
    table; null fields are empty.
    """
    fields = ["url", "title", "headings", "text"]
    narrow = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])
    tokens = narrow.withColumn("tokens", document_terms("text", "headings", "title")).withColumn("own", F.slice("tokens", 1, F.size(terms("text"))))
    tokens = written(tokens.select("url", "title", near_hash("text").alias("hash"), "tokens", "own"), "terms")  # each text is read once
    out = "rank int, url string, title string, score double, matched array<string>"
    index = build_bm25_index(tokens, question)
    if not index.query_terms or not index.n:
        return docs.sparkSession.createDataFrame([], out)
    scored = tokens.select("url", "title", "hash", "own", bm25_score(index, "tokens").alias("score"), bm25_matched(index, "tokens").alias("matched"))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    dropped(tokens)
    stays = _distinct(scored)
    words = F.transform(F.array_distinct("own"), lambda t: F.xxhash64(t))
    places = mmr_places(scored.join(stays, "row").select("row", "url", "score", words.alias("words")), limit)
    most = F.greatest(F.lit(1e-9), F.lit(scored.agg(F.max("score")).first()[0]))
    told = scored.select("row", "url", "title", "score", "matched").join(places, "row")
    report = told.select(F.col("place").cast("int").alias("rank"), "url", "title", F.round(F.col("score") / most, 4).alias("score"), "matched")
    return report if limit is None else report.orderBy("rank")


def _distinct(scored: DataFrame) -> DataFrame:
    """The ``row`` of all candidates that are no near copies of a better one."""
    keys = [F.col("score").desc(), F.col("url"), F.col("row")]
    numbered = ranked(scored.select("row", "score", "url"), keys, "rank").select("row", "rank")
    hashed = scored.select("row", "hash").join(numbered, "row")
    return collapse_hashes(written(hashed, "hashes"), "rank", "hash").where("kept").select("row")


def hybrid_search(docs: DataFrame, question: str, question_vector: Sequence[float] | None = None, limit: int = 10, k: int = 60, pos: str = "pos") -> DataFrame:
    """Lexical and dense ranks fused: ``docs(pos, id, title, headings, body[, vec])`` to ``id, score, lexical_rank, dense_rank, place``.

    Ties keep input order. Without a question vector the lexical lane decides alone.
    Every document is ranked; one without a vector is not in the dense lane and
    gets no part of its score.
    """
    tokens = docs.withColumn("tokens", document_terms("body", "headings", "title"))
    index = build_bm25_index(tokens, question)
    lanes = tokens.select(pos, "id", bm25_score(index, "tokens").alias("lexical"), *([F.col("vec").isNotNull().alias("has_vec"), cosine("vec", F.array(*[F.lit(float(x)) for x in question_vector])).alias("dense")] if question_vector else []))

    def lane(lanes: DataFrame, score: str) -> DataFrame:
        """Ranks come from the sorted output's gapless numbering rather than from one window over all rows."""
        return ranked(lanes.select(pos, "id", score), [F.col(score).desc(), F.col(pos)], f"{score}_rank")

    fused = lane(lanes, "lexical").select(pos, "id", "lexical_rank")
    score = 1.0 / (k + F.col("lexical_rank"))
    if question_vector:
        fused = fused.join(lane(lanes.where("has_vec"), "dense").select(pos, "dense_rank"), pos, "left")
        score = score + F.coalesce(1.0 / (k + F.col("dense_rank")), F.lit(0.0))
    else:
        fused = fused.withColumn("dense_rank", F.lit(None).cast("long"))
    top = fused.withColumn("score", score).orderBy(F.col("score").desc(), pos).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), pos))).drop(pos)



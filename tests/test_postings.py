"""Many questions over an inverted index against the score of every document for every question."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import postings, ranking


def made_up(spark, n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, [rng.choice(words[: rng.choice([5, 20, 60])]) for _ in range(rng.randrange(0, 40))]) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(4)] + [(n + 9, None)]  # ties, nothing
    asked = [(q, rng.sample(words, rng.randrange(1, 6))) for q in range(12)] + [(50, ["w1", "w1", "w2"]), (51, []), (52, None), (53, ["nowhere"])]
    return spark.createDataFrame(docs, "id long, tokens array<string>"), spark.createDataFrame(asked, "q long, terms array<string>"), asked


def plain(docs, asked, k):
    """``ranking.bm25_score`` of every document, question by question."""
    docs = docs.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    out = []
    for q, terms in asked:
        terms = list(dict.fromkeys(terms or []))
        seen = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("l"), *[F.count_if(F.array_contains("tokens", t)).alias(t) for t in terms]).first()
        import math

        idf = tuple(1.0 if seen.n < 3 else math.log(1 + (seen.n - seen[t] + 0.5) / (seen[t] + 0.5)) for t in terms)
        index = ranking.Bm25Index(tuple(terms), seen.n, float(seen.l), idf)
        scored = docs.select("id", F.round(ranking.bm25_score(index, "tokens"), 6).alias("s")).where("s > 0").collect()
        best = sorted(scored, key=lambda r: (-r.s, r.id))[:k]
        out += [(q, r.id, pytest.approx(r.s, abs=2e-6), i) for i, r in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block", [4, 1000])
def test_the_best_of_every_question(spark, block):
    docs, questions, asked = made_up(spark, 120)
    index = postings.build_postings(docs, "id", "tokens", block=block)
    got = sorted((r.question, r.doc, r.score, r.place) for r in postings.search_postings(index, questions, "q", "terms", k=5).collect())
    want = sorted(plain(docs, asked, 5), key=lambda r: (r[0], r[1]))
    assert len(got) == len(want) and got == want


def test_blocks_below_the_kth_score_stay_closed(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["rare"] * 3 if i < 3 else ["common"] + ["fill"] * (i % 50)) for i in range(400)], "id long, tokens array<string>")
    index = postings.build_postings(docs, "id", "tokens", block=8)
    opened = []
    real = postings._scores
    monkeypatch.setattr(postings, "_scores", lambda i, o, a: opened.append(o.count()) or real(i, o, a))
    questions = spark.createDataFrame([(1, ["rare", "common"])], "q long, terms array<string>")
    got = postings.search_postings(index, questions, "q", "terms", k=2).orderBy("place").collect()
    assert [r.doc for r in got] == [0, 1] and index.maxima.select("block").distinct().count() > 30 and opened[1] < 15


def test_empty_sides(spark):
    docs, questions, _ = made_up(spark, 5)
    none = postings.build_postings(docs.limit(0), "id", "tokens")
    assert postings.search_postings(none, questions, "q", "terms").collect() == []
    assert postings.search_postings(postings.build_postings(docs, "id", "tokens"), questions.limit(0), "q", "terms").collect() == []

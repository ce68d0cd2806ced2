"""Marginal relevance over whole pools against the plain loop, whatever the blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import diversity, ranking


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def plain(items, weight=0.75):
    """``items``: (name, score, set); the names in the order taken."""
    if len(items) <= 2:
        return [i[0] for i in sorted(items, key=lambda i: (-i[1], i[0]))]
    top = max(max(i[1] for i in items), 1e-9)
    most = max(jaccard(a[2], b[2]) for k, a in enumerate(items) for b in items[:k])
    left, out, worst = dict((i[0], i) for i in items), [], dict.fromkeys((i[0] for i in items), 0.0)
    while left:
        pick = min(left, key=lambda n: (-(weight * (left[n][1] / top) - (1 - weight) * worst[n]), n))
        words = left.pop(pick)[2]
        out.append(pick)
        for n in left:
            worst[n] = max(worst[n], jaccard(left[n][2], words) / most if most else 0.0)
    return out


def pool_of(spark, items):
    return spark.createDataFrame([(k, n, float(s), sorted(w)) for k, (n, s, w) in enumerate(items)], "row long, url string, score double, words array<long>")


def ordered(places, items):
    return [items[r.row][0] for r in sorted(places.collect(), key=lambda r: r.place)]


def made_up(n, seed, vocabulary=200):
    rng = random.Random(seed)
    topics = [rng.sample(range(vocabulary), 30) for _ in range(12)]
    items = []
    for i in range(n):
        words = set(rng.sample(rng.choice(topics), rng.randrange(0, 25))) | set(rng.sample(range(vocabulary), rng.randrange(0, 6)))
        items.append((f"u{i:04}", rng.choice([0.0, 0.5, rng.random() * 3]), words))
    return items


@pytest.mark.parametrize("block, terms", [(8192, 1 << 22), (40, 1 << 22), (300, 500)])
def test_blocks_give_the_plain_order(spark, monkeypatch, block, terms):
    monkeypatch.setattr(diversity, "BLOCK", block)
    monkeypatch.setattr(diversity, "BLOCK_TERMS", terms)
    items = made_up(130, block)
    places = diversity.mmr_places(pool_of(spark, items))
    assert sorted(r.place for r in places.collect()) == list(range(1, 131))
    assert ordered(places, items) == plain(items)


def test_a_limit_reads_one_block(spark, monkeypatch):
    monkeypatch.setattr(diversity, "BLOCK", 60)
    taken = []
    real = diversity._take
    monkeypatch.setattr(diversity, "_take", lambda block, *a: taken.append(block.count()) or real(block, *a))
    items = [(f"u{i:04}", 1.0 / (1 + i), {i, i + 1, i % 7}) for i in range(400)]
    assert ordered(diversity.mmr_places(pool_of(spark, items), limit=5), items) == plain(items)[:5]
    assert taken == [60]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_largest_likeness_is_exact(spark, seed):
    rng = random.Random(seed)
    sets = [set(rng.sample(range(400), rng.randrange(1, 40))) for _ in range(150)] + [set()]
    if seed == 1:
        sets.append(set(list(sets[0])[1:]))
    pool = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "row long, words array<long>")
    want = max(jaccard(a, b) for k, a in enumerate(sets) for b in sets[:k])
    assert diversity.greatest_likeness(pool) == pytest.approx(want, abs=1e-12)
    apart = spark.createDataFrame([(k, [k]) for k in range(20)], "row long, words array<long>")
    assert diversity.greatest_likeness(apart) == 0 and diversity.greatest_likeness(apart.limit(0)) == 0


def test_diversify_of_one_pool_and_of_groups_agree(spark):
    items = made_up(60, 9)
    rows = [(i, n, s, [f"t{w}" for w in words] or None) for i, (n, s, words) in enumerate(items)]
    df = spark.createDataFrame(rows, "pos int, url string, score double, tokens array<string>")
    one = {r.url: r.place for r in ranking.diversify(df).collect()}
    grouped = {r.url: r.place for r in ranking.diversify(df.withColumn("g", F.lit(1)), group="g").collect()}
    assert one == grouped and [n for n, _ in sorted(one.items(), key=lambda x: x[1])] == plain(items)
    two = ranking.diversify(df.where("pos < 2").withColumn("pos", -F.col("pos")))
    assert [r.url for r in sorted(two.collect(), key=lambda r: r.place)] == ["u0001", "u0000"]
    assert ranking.diversify(df.limit(0)).collect() == []


def test_every_document_that_stays_is_ranked_as_in_the_plain_loop(spark):
    """Over the whole documents of a larger table: scores and near copies from their own operators, the order from the loop."""
    from textmill.functions.text import terms
    from textmill.plans.registry import as_documents
    from textmill.plans.catalog import QUESTION

    docs = as_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("length(text) < 3000")
    got = ranking.rank_documents(docs, QUESTION).orderBy("rank").collect()
    assert len(got) > 500 and [r.rank for r in got] == list(range(1, len(got) + 1))
    tokens = docs.withColumn("tokens", ranking.document_terms("text", "headings", "title"))
    index = ranking.build_bm25_index(tokens, QUESTION)
    rows = {r.url: r for r in tokens.select("url", ranking.bm25_score(index, "tokens").alias("score"), terms("text").alias("own")).collect()}
    items = [(r.url, rows[r.url].score, set(rows[r.url].own)) for r in got]
    assert [r.url for r in got] == plain(items)


def test_intersections_come_from_the_inverted_index():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 20))) for _ in range(40)] + [np.zeros(0, np.int64)]
    postings = diversity.Postings(sets)
    for s in sets[:10] + [np.array([3, 999])]:
        want = [jaccard(set(s.tolist()), set(o.tolist())) for o in sets]
        assert postings.likeness(s).tolist() == pytest.approx(want)
    assert diversity.Postings([]).likeness(np.array([1])).tolist() == []

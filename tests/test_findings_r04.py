"""Findings of the fourth round."""

import numpy as np
import pytest

from test_diversity import jaccard, made_up, ordered, plain, pool_of
from textmill.operators import diversity


def test_blocks_grow_with_what_is_taken(spark, monkeypatch):
    """as many rounds as there were blocks of one size made larger tables end too late."""
    monkeypatch.setattr(diversity, "BLOCK", 12)
    rounds = []
    real = diversity._take
    monkeypatch.setattr(diversity, "_take", lambda block, *a: rounds.append(block.count()) or real(block, *a))
    items = made_up(150, 4) + [(f"v{i:03}", 0.0, {1, 2, 3, 500 + i // 20}) for i in range(40)]
    assert ordered(diversity.mmr_places(pool_of(spark, items)), items) == plain(items)
    assert len(rounds) < len(items) / 12 and max(rounds) > 12


def test_items_with_many_links_are_compared_where_they_are_taken(spark, monkeypatch):
    monkeypatch.setattr(diversity, "LINKS", 2)
    monkeypatch.setattr(diversity, "BLOCK", 30)
    items = [(f"u{i:03}", 0.1 * (i % 3), {i % 5, 10 + i % 7, 20 + i}) for i in range(60)]
    assert ordered(diversity.mmr_places(pool_of(spark, items)), items) == plain(items)


@pytest.mark.parametrize("n", [1, 40, 41])
def test_common_terms_are_counted_by_a_product(monkeypatch, n):
    monkeypatch.setattr(diversity, "COMMON", 8)
    monkeypatch.setattr(diversity, "AT_ONCE", 7)
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 28))) for _ in range(n - 1)] + [np.zeros(0, np.int64)]
    asked = [*sets[:20], np.array([2, 7, 999]), np.zeros(0, np.int64)]
    postings = diversity.Postings(sets)
    got = np.concatenate([both.copy() for _, both in postings.shared(asked)])
    assert got.tolist() == [[len(set(a.tolist()) & set(s.tolist())) for s in sets] for a in asked]
    some = np.arange(n) % 2 == 0
    likeness = np.concatenate([near.copy() for _, _, near in postings.near(asked, some)])
    want = [[jaccard(set(a.tolist()), set(s.tolist())) if k else 0.0 for s, k in zip(sets, some)] for a in asked]
    assert np.allclose(likeness, want, rtol=diversity.NEAR / 10)


def test_equal_sets_end_the_search_for_the_largest_likeness(spark, monkeypatch):
    monkeypatch.setattr(diversity, "_hashed", None)
    pool = spark.createDataFrame([(1, [2, 5]), (2, [3]), (3, [2, 5]), (4, [])], "row long, words array<long>")
    assert diversity.greatest_likeness(pool) == 1.0

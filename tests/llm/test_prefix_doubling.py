"""Repeated byte strings against a set of all strings seen so far."""

import hashlib
import random

import pytest

from textmill.llm import prefix_doubling
from textmill.llm.queries import op12_prefix_doubling_repeats


def brute(rows, need=100):
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - need + 1):
            if b[i : i + need] in seen:
                gone[i : i + need] = [True] * need
            seen.add(b[i : i + need])
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def copies_with_edits(seed=5, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(5)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base)[rng.randrange(1000) :][: rng.randrange(50, 2000)])
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("xyzé漢")
        rows.append((i, "".join(t)))
    return rows, base


@pytest.mark.parametrize("parts", [1, 6])
@pytest.mark.parametrize("need", [64, 100, 230])
def test_equals_brute_force_on_copies_periods_and_borders(spark, parts, need):
    rows, base = copies_with_edits()
    odd = [None, "", "a" * 700, "a" * 150, "ab" * 300, "b" * 99, "a" * 100, "ba" * 60 + "a" * 120, base[0], base[0], "xyz" * 200, " " * 101]
    rows += [(100 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert got(prefix_doubling.remove_repeats(df, need)) == brute(rows, need)


def test_equals_brute_force_on_all_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert got(op12_prefix_doubling_repeats(spark, sf)) == brute(rows)


def test_a_string_shared_by_all_is_ranked_over_several_tasks(spark):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefghij") for _ in range(160))
    rows = [(i, "".join(rng.choice("klmnopq") for _ in range(40)) + line + "".join(rng.choice("klmnopq") for _ in range(30))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    pieces = spark.createDataFrame([(0, 0, 0, 0, 0)], "k1 long, k2 long, doc long, at int, rounds int").limit(0)
    same = pieces.unionByName(spark.range(4000).selectExpr("7L as k1", "9L as k2", "id as doc", "0 as at", "1 as rounds"))
    ranked = prefix_doubling.reranked(same, "same").toPandas()
    assert ranked["rank"].nunique() == 1 and ranked[ranked["first"]]["doc"].tolist() == [0] and not ranked["single"].any()
    assert got(prefix_doubling.remove_repeats(df)) == brute(rows)


def test_long_texts_are_read_piecewise(spark, monkeypatch):
    monkeypatch.setattr(prefix_doubling, "AT_ONCE", 700)
    rows, base = copies_with_edits(7, 20)
    rows.append((50, base[1] * 3))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    import numpy as np

    text = base[1].encode() * 3
    whole = [np.concatenate(v) for v in zip(*prefix_doubling.runs_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 100))]
    assert whole[2].sum() == len(text) - 99 and (np.diff(whole[1]) == whole[2][:-1]).all()
    assert got(prefix_doubling.remove_repeats(df)) == brute(rows)


def test_odd_tables(spark):
    """Null and repeated ids, ids that are no numbers, clashing columns, no rows, nothing as long as asked."""
    a, b = "x1" * 80 + "tail", "y2" * 90
    df = spark.createDataFrame([(None, a, 1), (3, a, 2), (3, b, 3), (3, b, 4), (1, b[:130], 5), (None, None, 6)], "doc_id long, text string, doc int")
    out = prefix_doubling.remove_repeats(df)
    ordered = [(1, b[:130]), (3, a), (3, b), (3, b), (None, None), (None, a)]
    assert got(out) == brute(ordered)
    named = df.selectExpr("cast(doc_id as string) as doc_id", "text", "1 as at", "2 as n")
    assert got(prefix_doubling.remove_repeats(named)) == brute([(None if i is None else str(i), t) for i, t in ordered])
    assert prefix_doubling.remove_repeats(df.limit(0)).collect() == []
    assert [r.n_removed for r in prefix_doubling.remove_repeats(spark.createDataFrame([(1, "short"), (2, "short")], "doc_id int, text string")).collect()] == [0, 0]
    kept = prefix_doubling.remove_repeats(spark.createDataFrame([(1, a), (2, a + "more")], "doc_id long, text string"), with_text=True)
    assert {r.doc_id: bytes(r.kept) for r in kept.collect()}[2] == b"more"
    with pytest.raises(ValueError):
        prefix_doubling.remove_repeats(df, need=20)

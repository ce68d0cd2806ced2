"""Coverage of many questions in one pass against each question's own matcher."""

import pytest
from pyspark.sql import functions as F

from textmill.functions.text import build_matcher, plain_text
from textmill.operators import matching

QUESTIONS = [(1, "How do batteries of the XMLHttpRequest retry?"), (2, "préférence élève"), (3, "the of and"), (4, None), (5, "batteries queries"), (6, "parseHTTP2Frame token_bucket")]
TEXTS = [(1, "A BATTERY and one xmlhttprequest"), (2, "Préférences des élèves"), (3, "preference ELEVE queries"), (4, None), (5, ""), (6, "frame of tokens"), (7, "nothing"), (8, "token_bucket http2"), (8, "batterie")]


@pytest.mark.parametrize("told", [1 << 20, 60])
def test_equals_every_matcher(spark, told):
    docs = spark.createDataFrame(TEXTS, "d long, t string").repartition(3)
    questions = spark.createDataFrame(QUESTIONS, "q long, t string")
    got = matching.coverage_of_questions(docs, questions, "d", "t", "q", "t", told=told).collect()
    want = []
    for q, text in QUESTIONS:
        matcher = build_matcher(text or "")
        if matcher.keywords:
            rows = docs.select("d", matcher.n_hits(F.coalesce("t", F.lit(""))).alias("h")).where("h > 0").collect()
            want += [(q, r.d, r.h, r.h / len(matcher.keywords)) for r in rows]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 8


def test_nothing_asked_or_nothing_to_read(spark):
    docs, questions = spark.createDataFrame(TEXTS, "d long, t string"), spark.createDataFrame(QUESTIONS, "q string, t string")
    for d, q in ((docs.limit(0), questions), (docs, questions.limit(0)), (docs, questions.where("q = '3'"))):
        out = matching.coverage_of_questions(d, q, "d", "t", "q", "t")
        assert out.columns == ["question", "doc", "hits", "coverage"] and out.collect() == []
    assert plain_text("ÉlÈve") == "eleve"

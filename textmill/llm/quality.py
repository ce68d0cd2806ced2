"""Quality by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its text. The weights minimise the
logistic loss of worth differences over preference pairs: of a good and a bad
document the good one is preferred. The decision threshold is a quantile of the
training scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import narrow_batches
from textmill.llm.labelled import held_out, training_rows

CLASSES = 11
SEGMENTS = 6


def _class_table() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line end, stop, shout, bracket or quote, sign, UTF-8 lead, UTF-8 tail."""
    table = np.full(256, 8, dtype=np.uint8)
    for c, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"()[]{}\"'`")):
        table[list(chars)] = c
    table[0xC0:], table[0x80:0xC0] = 9, 10
    return table


_TABLE = _class_table()


def features(text: str | None) -> np.ndarray:
    """Fixed-length features of a whole text: class bigram shares, word and line repetition, extremes over segments."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = _TABLE[np.frombuffer(data, dtype=np.uint8)]
    n = len(kinds)
    pairs = np.bincount(kinds[:-1].astype(np.int64) * CLASSES + kinds[1:], minlength=CLASSES**2) / max(1, n - 1)
    words = data.split()
    m = len(words)
    count = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:])) / max(1, m - 1)
    lines = data.split(b"\n")
    tails = Counter(w[-1:] for w in words)
    word = [
        np.log1p(n),
        np.log1p(m),
        n / max(1, m) / 10,
        len(count) / max(1, m),
        repeats,
        max(count.values(), default=0) / max(1, m),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(c for t, c in tails.items() if not t.isalnum() and t < b"\x80") / max(1, m),
        sum(len(w) == 1 for w in words) / max(1, m),
        float(m == 0),
    ]
    parts = np.array_split(kinds, SEGMENTS)
    shares = np.array([np.bincount(p, minlength=CLASSES) / max(1, len(p)) for p in parts])
    cuts = [words[m * k // SEGMENTS : m * (k + 1) // SEGMENTS] for k in range(SEGMENTS)]
    fresh = [len(set(c)) / max(1, len(c)) for c in cuts]
    return np.concatenate([np.sqrt(pairs), np.sqrt(shares.max(axis=0)), shares.min(axis=0), [min(fresh), max(fresh)], word])


WIDTH = len(features(""))


@dataclass(frozen=True)
class Ranking:
    """Weights over standardised features and the threshold, on the raw scale, of good documents."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    cut: float  # the score that the threshold is mapped to

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.worth(x) - self.threshold) * self.scale + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, rounds: int = 300, ridge: float = 1e-4, cut: float = 0.3, seed: int = 11) -> Ranking:
    """Learn from preference pairs good over bad; with one kind of label only, every document is worth the same."""
    mean = x.mean(axis=0) if len(x) else np.zeros(WIDTH)
    spread = x.std(axis=0) + 1e-6 if len(x) else np.ones(WIDTH)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, spread, np.zeros(WIDTH), 0.0, 1.0, cut)
    z = np.clip((x - mean) / spread, -6, 6)
    rng = np.random.default_rng(seed)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, m, v = np.zeros(z.shape[1]), 0.0, 0.0
    for t in range(1, rounds + 1):
        worth = z @ w
        p = 1 / (1 + np.exp(np.clip(worth[i] - worth[j], -40, 40)))  # chance that the pair is ranked wrongly
        pull = np.bincount(i, p, len(z)) - np.bincount(j, p, len(z))
        grad = -(z.T @ pull) / pairs + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    worth = z @ w
    quantiles = np.unique(np.quantile(worth, np.linspace(0, 1, 401)))
    agree = [((worth >= q) == (y == 1)).mean() for q in quantiles]
    best = np.flatnonzero(np.array(agree) >= max(agree) - 1e-12)
    return Ranking(mean, spread, w, float(quantiles[best[len(best) // 2]]), 1.0 / max(1e-6, float(worth.std())) * 2, cut)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 12_000) -> Ranking:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold; only their features reach the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = [features(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.binary())], names=["y", "x"])

    rows = training_rows(docs, labels, label, sample_rows).select("text", "y").mapInArrow(run, "y int, x binary").collect()
    rows.sort(key=lambda r: (bytes(r.x), r.y))
    x = np.array([np.frombuffer(r.x, dtype=np.float32) for r in rows], dtype=np.float64).reshape(len(rows), WIDTH)
    return fit_bradley_terry(x, np.array([r.y for r in rows], dtype=int))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted`` (1 if score >= ``cut``).

    Only the text enters a score. Null texts count as empty and are scored;
    null ids are held out; labels that are null or neither 0 nor 1 teach
    nothing; without labels of both kinds every score is ``cut``. Texts of any
    length are read whole. Repeated rows and equal texts score alike (ties); an
    empty table gives no rows; other columns, whatever their names, play no part.
    """
    rows = narrow_batches(docs, id_col, text_col).toDF("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(learn(rows, labels, "quality", sample_rows))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(x))], names=["doc_id", "score"])

    id_type = dict(rows.dtypes)["doc_id"]
    scored = rows.mapInArrow(run, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))

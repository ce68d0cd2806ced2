"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the wording that sets toxic
texts apart and one on ordinary wording. A window (one word, twice, behind a
fixed primer that both dictionaries end with) is compressed with each; how many
bytes each saves is the evidence. A text's distribution of savings is calibrated
to a probability by logistic regression on labelled rows the dictionaries did
not see.

A dictionary's content is chosen by a likelihood ratio, since zstandard's own
trainer picks what is frequent, which toxic and ordinary texts share; the README
has figures for both, and for longer windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from textmill.llm.common import dropped, fresh_name, narrow_batches, written
from textmill.llm.labelled import held_out, training_rows

PRIMER = bytes(48)
WINDOW = 32
LEVEL = 9
STEPS = 12
REMEMBERED_WINDOWS = 250_000
#: Bounds on what a segment must set apart, as (log likelihood ratio, ratio per toxic text): wording usual in toxic
#: texts, surely typical, probably typical. The calibration rows choose between them.
BOUNDS = ((12.0, 1 / 16), (12.0, 0.0), (7.0, 0.0))
_WIDTH = STEPS * 2 + (2 * STEPS - 1) * 2 + 1


def windows_of(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z lower-cased; longer ones are cut in windows."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not any(len(w) > WINDOW for w in words):
        return words
    return [w[k : k + WINDOW] for w in words for k in range(0, len(w), WINDOW)]


def segments_of(window: bytes) -> set[bytes]:
    """What a dictionary may learn from a window: the word and its heads."""
    whole = b" " + window + b" "
    return {whole} | {whole[:n] for n in (4, 5, 6, 7) if len(whole) > n + 1}


class Savings(dict):
    """``window -> code``, the bytes saved with either dictionary in steps; bounded in size."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.made = [self._compressor(d) for d in (toxic, ordinary)]
        self.base = [len(c.compress(PRIMER)) for c in self.made]

    @staticmethod
    def _compressor(content: bytes) -> zs.ZstdCompressor:
        held = zs.ZstdCompressionDict(content + PRIMER, dict_type=zs.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        params = zs.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(content) + len(PRIMER), source_size=128, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS
        )
        return zs.ZstdCompressor(dict_data=held, compression_params=params)

    def __missing__(self, window: bytes) -> int:
        whole = b" " + window + b" "
        saved = [min(STEPS - 1, max(0, b + len(whole) + 4 - len(c.compress(PRIMER + whole + whole)))) for c, b in zip(self.made, self.base)]
        code = saved[0] * STEPS + saved[1]
        if len(self) >= REMEMBERED_WINDOWS:
            self.clear()
        self[window] = code
        return code

    def features(self, text: str | None) -> np.ndarray:
        """Counts, on a log scale, and shares of savings with the toxic dictionary and of the difference of the two."""
        words = windows_of(text)
        table = np.bincount(list(map(self.__getitem__, words)) or [0], minlength=STEPS * STEPS).reshape(STEPS, STEPS).astype(float)
        if not words:
            table[:] = 0
        n = len(words) + 1
        toxic = table.sum(axis=1)
        gap = np.array([np.trace(table, -k) for k in range(1 - STEPS, STEPS)])
        return np.concatenate([np.log1p(toxic), 10 * toxic / n, np.log1p(gap), 10 * gap / n, [np.log(n)]])


@dataclass
class Toxicity:
    """Both dictionaries and the calibration."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 1500, prior: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, spread, weights and bias; ``prior`` is the weight decay of the whole sample, so few rows are trusted less."""
    mean = x.mean(axis=0) if len(x) else np.zeros(_WIDTH)
    spread = x.std(axis=0) + 1e-6 if len(x) else np.ones(_WIDTH)
    if len(set(y.tolist())) < 2:
        return mean, spread, np.zeros(_WIDTH), 4.0 if len(y) and y[0] else -4.0
    z = np.clip((x - mean) / spread, -8, 8)
    ridge = prior / len(y)
    w, b = np.zeros(_WIDTH), 0.0
    m, v = np.zeros(_WIDTH + 1), np.zeros(_WIDTH + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -40, 40)))
        g = np.append(z.T @ (p - y) / len(y) + ridge * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return mean, spread, w, float(b)


def _content(ranked: list[bytes], size: int) -> bytes:
    """Best segments last, where matches are cheapest."""
    kept, total = [], 0
    for s in ranked:
        if total + len(s) > size:
            break
        kept.append(s)
        total += len(s)
    return b"".join(reversed(kept))


def _novel(ranked: Iterable[bytes]) -> list[bytes]:
    """Segments that no better one contains."""
    kept, seen = [], b""
    for s in ranked:
        if s not in seen:
            kept.append(s)
            seen += s
    return kept


def one_of_near_copies(sample: DataFrame) -> DataFrame:
    """``text, y``: of the texts of a label whose five-word shingles have the same two minima, the least one.

    Near copies mostly share both, so a word that they alone use counts a few times rather than once a copy.
    """

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            least = []
            for t in batch.column("text"):
                words = (t.as_py() or "").lower().split()
                spans = [" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
                least.append(b"".join(min(xxh64_digest(s, seed) for s in spans) for seed in (1, 2)))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("y"), pa.array(least, pa.binary())], names=["text", "y", "least"])

    told = sample.select("text", "y").mapInArrow(keyed, "text string, y int, least binary")
    return told.groupBy("y", "least").agg(F.min("text").alias("text")).select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 16_000, dictionary_bytes: int = 8192) -> Toxicity:
    """Train on at most ``sample_rows`` labelled rows outside the held-out fold: two thirds the dictionaries, the rest the calibration.

    The toxic dictionary holds the segments whose log likelihood ratio passes
    a bound, counted once per group of near copies, the ordinary one the most usual segments, each at most
    ``dictionary_bytes`` long. Of the dictionaries of all ``BOUNDS`` that stays which, calibrated on one half of
    the calibration rows, tells the other half best, either way round.
    """
    sample = written(training_rows(docs, labels, label, sample_rows, parts=3), "labelled")

    def segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in it:
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                seen[y].update(set().union(*map(segments_of, set(windows_of(t.as_py())))))
                seen[y][b""] += 1
        for y, found in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array([n * y for n in found.values()], pa.int64()), pa.array([n * (1 - y) for n in found.values()], pa.int64())],
                names=["segment", "toxic", "ordinary"],
            )

    taught = one_of_near_copies(sample.where(F.col("part") > 0)).mapInArrow(segments, "segment binary, toxic long, ordinary long")
    counts = written(taught.groupBy("segment").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "segments")
    size = counts.where(F.length("segment") == 0).first()
    n1, n0 = (size.toxic, size.ordinary) if size else (0, 0)
    share, usual_share = (F.col("toxic") + 0.5) / (n1 + 1), (F.col("ordinary") + 0.5) / (n0 + 1)
    gain = F.col("toxic") * F.ln(share / usual_share) - n1 * (share - usual_share)  # log likelihood ratio of two Poisson rates
    words = counts.where(F.length("segment") > 0)
    best = words.where((share > usual_share) & (gain > min(max(least, part * n1) for least, part in BOUNDS))).select("segment", gain.alias("gain")).orderBy(gain.desc(), "segment").limit(dictionary_bytes)
    usual = words.where(F.col("ordinary") > 0).orderBy(F.col("ordinary").desc(), "segment").limit(dictionary_bytes)
    ranked = [(bytes(r.segment), r.gain) for r in best.collect()]
    tried = [_content(_novel(seg for seg, g in ranked if g > max(least, part * n1)), dictionary_bytes) for least, part in BOUNDS]
    tried = list(dict.fromkeys(tried))
    ordinary = _content([bytes(r.segment) for r in usual.collect()], dictionary_bytes)
    dropped(counts)

    def evidence(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = [Savings(toxic, ordinary) for toxic in tried]
        for batch in it:
            x = [np.concatenate([s.features(t.as_py()) for s in savings]).astype(np.float32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.binary())], names=["y", "x"])

    rows = sample.where(F.col("part") == 0).select("text", "y").mapInArrow(evidence, "y int, x binary").collect()
    dropped(sample)
    rows.sort(key=lambda r: (bytes(r.x), r.y))
    x = np.array([np.frombuffer(r.x, dtype=np.float32) for r in rows], dtype=np.float64).reshape(len(rows), len(tried), _WIDTH)
    y = np.array([r.y for r in rows], dtype=float)

    def unexplained(k: int) -> float:
        """The loss of dictionary ``k`` on each half of the rows, fitted on the other."""
        loss = 0.0
        for half in (0, 1):
            model = Toxicity(tried[k], ordinary, *fit_logistic(x[half::2, k], y[half::2]))
            p = np.clip(model.scores(x[1 - half :: 2, k]), 1e-6, 1 - 1e-6)
            loss -= np.log(np.where(y[1 - half :: 2] == 1, p, 1 - p)).sum()
        return loss

    k = min(range(len(tried)), key=unexplained) if len(tried) > 1 else 0
    return Toxicity(tried[k], ordinary, *fit_logistic(x[:, k], y))


def with_score(docs: DataFrame, model: Toxicity, text_col: str = "text", out: str = "score") -> DataFrame:
    """Append the probability of label 1, from the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = Savings(held.value.toxic, held.value.ordinary)
        for batch in it:
            x = np.array([savings.features(t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, _WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(x))], names=[*batch.schema.names, out])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted`` (1 if score >= ``cut``).

    Only the text enters a score. Null texts count as empty and are scored;
    null ids are held out; labels that are null or neither 0 nor 1 teach
    nothing; without any label every score is the same low one. Words over ``WINDOW`` bytes are
    cut in windows and texts of any length read whole. Repeated rows and equal
    texts score alike (ties); an empty table gives no rows; other columns,
    whatever their names, play no part.
    """
    rows = narrow_batches(docs, id_col, text_col).toDF("doc_id", "text")
    scored = with_score(rows, learn(rows, labels, "toxic", sample_rows)).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000, cut: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored ``cut`` or more, all columns unchanged, clashing names included.

    Nulls, empties, long and repeated texts as in ``score_toxicity``; without
    any label everything stays. An empty
    table gives none back.
    """
    model = learn(docs.select("doc_id", "text"), labels, "toxic", sample_rows)
    name = fresh_name(docs, "toxic_score")
    return with_score(docs, model, out=name).where(F.col(name) < cut).select(*[F.col(f"`{c}`") for c in docs.columns])

"""The page cache as a stream: visits in the order of time, a page's entries as keyed state with a timer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textmill.operators.cuts import work_path

#: What a visit may ask for: the usual path, a new copy, no network, no cache.
MODES = ("normal", "refresh", "offline", "off")
VISIT = "url string, seq long, now_ms long, namespace string, mode string, status int, text string, etag string"
SERVED = "url string, seq long, text string, source string, note string, cached_at long, store boolean"
#: What the stateful step gives: a page's visits of a batch in one row, since every row of a worker has its price.
_TOLD = f"url string, served array<struct<{', '.join(field.replace(' ', ': ') for field in SERVED.split(', ')[1:])}>>"
_told = Row("url", "served")


class Entry(NamedTuple):
    text: str
    etag: str | None
    cached_at: int


class Answer(NamedTuple):
    text: str
    source: str
    note: str | None = None
    cached_at: int | None = None
    store: bool = False


def serve(entries: dict[str, Entry], visit: dict, ttl_ms: int, keep_ms: int) -> Answer:
    """Answer a visit from ``entries`` (one per namespace, changed in place) or from what its origin says."""
    now, space, mode = visit["now_ms"], visit.get("namespace") or "native", visit.get("mode") or "normal"
    status, text = visit.get("status") or 0, visit.get("text") or ""
    readable = bool(text.strip(" "))
    alive = {n: e for n, e in entries.items() if now - e.cached_at < keep_ms}
    newest = max(alive.items(), key=lambda held: (held[1].cached_at, held[0]))[1] if alive else None
    from_origin = Answer(text, "response", None, now) if readable else Answer("", "none", f"status {status}")
    if mode == "off":
        return from_origin
    if mode == "offline":
        return Answer(newest.text, "cache", None, newest.cached_at) if newest else Answer("", "none", f"Offline: {visit.get('url')} is not in the cache")
    hit = alive.get(space) if mode != "refresh" else None
    if hit and now - hit.cached_at < ttl_ms:
        return Answer(hit.text, "cache", None, hit.cached_at)
    if hit and hit.etag and status == 304:
        entries[space] = hit._replace(cached_at=now)
        return Answer(hit.text, "cache", None, now, True)
    if readable:
        entries[space] = Entry(text, visit.get("etag") or None, now)
        return from_origin._replace(store=True)
    held = hit or newest
    return Answer(held.text, "stale", f"{visit.get('url')} returned {status or 'no response'}; served the cached copy", held.cached_at) if held else from_origin


class _Cache(StatefulProcessor):
    """The entries of a page, one per namespace, and one timer, never after the first of them is too old for any use."""

    def __init__(self, ttl_ms: int, keep_ms: int):
        self.ttl_ms, self.keep_ms = ttl_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "held array<struct<namespace string, text string, etag string, cached_at long>>")

    def _held(self) -> dict[str, Entry]:
        kept = self.entries.get()
        return {e[0]: Entry(*e[1:]) for e in kept[0]} if kept else {}

    def _hold(self, entries: dict[str, Entry]) -> None:
        self.entries.update(([(space, *entry) for space, entry in entries.items()],))

    def _wake(self, entries: dict[str, Entry]) -> None:
        self.handle.registerTimer(min(e.cached_at for e in entries.values()) + self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._held()
        entries, visits = dict(before), sorted((json.loads(r.visit) for r in rows), key=lambda v: (v["now_ms"], "seq" not in v, v.get("seq", 0)))
        served = [(v.get("seq"), *serve(entries, v, self.ttl_ms, self.keep_ms)) for v in visits]
        if entries != before:
            self._hold(entries)
            if not before:  # else a timer is set already, at the end of the oldest of them or before
                self._wake(entries)
        return iter([_told(key[0], served)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs() - self.keep_ms
        entries = self._held()
        alive = {space: e for space, e in entries.items() if e.cached_at > until}
        if alive:
            if len(alive) < len(entries):
                self._hold(alive)
            self._wake(alive)
        else:
            self.entries.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_read_through(visits: DataFrame, ttl_ms: int, keep_ms: int, late: str = "1 hour") -> DataFrame:
    """Serve a stream of ``VISIT`` rows by the rules of ``state.read_through``, each visit after those before it.

    ``mode``: ``normal``; ``refresh`` does not read its entry but writes one;
    ``offline`` serves the newest entry of any namespace and asks nobody;
    ``off`` neither reads nor writes. Of entries of equal age that of the greatest
    namespace counts as the newest. Entries ``keep_ms`` old or older serve nothing,
    not even as stale copies; the timer of their page frees them once the watermark,
    ``late`` behind the visits, has passed. The state is thus bounded by the pages visited
    within ``keep_ms``. A visit needs a time, after that of epoch 0, at which
    every watermark starts; null modes are ``normal``, null
    namespaces ``native``, null texts empty, null addresses one page.
    """
    fields = ["url", "seq", "now_ms", "namespace", "mode", F.col("status").cast("int").alias("status"), "text", "etag"]
    timed = visits.select("url", F.to_json(F.struct(*fields)).alias("visit"), F.timestamp_millis("now_ms").alias("at"))
    told = (
        timed.withWatermark("at", late)
        .groupBy("url")
        .transformWithState(_Cache(ttl_ms, keep_ms), outputStructType=_TOLD, outputMode="append", timeMode="EventTime")
    )
    return told.select("url", F.inline("served"))


@contextmanager
def on_disk_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state in RocksDB, which timers need and which is not held in memory."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def drained(parts: Iterable[DataFrame], operator: Callable[[DataFrame], DataFrame], label: str = "drained") -> DataFrame:
    """All that ``operator`` says about a stream whose rows come in ``parts``, one after the other.

    Each part is drained before the next is written, and every drain takes up the
    state that the one before left in the checkpoint.
    """
    folder, out, checkpoint = (f"{label}-{n}" for n in ("in", "out", "state"))
    spark = None
    for part in parts:
        if spark is None:
            spark = part.sparkSession
            folder, out, checkpoint = (work_path(spark, p) for p in (folder, out, checkpoint))
        part.write.mode("append").parquet(folder)
        with on_disk_state(spark):
            said = operator(spark.readStream.schema(part.schema).parquet(folder))
            run = said.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    if spark is None:
        raise ValueError("a stream needs one part at least")
    return spark.read.schema(said.schema).parquet(out)

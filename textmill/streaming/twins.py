"""Streaming forms of the stateful operators: pacing, change detection, first sightings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_host_slots(arrivals: DataFrame, delay_ms: int, host: str = "host") -> DataFrame:
    """Departure times of a stream of ``(host, seq, now_ms)``: the only state of a host is its next free slot."""

    def pace(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        spent = delay_ms * np.arange(len(rows))
        floor = rows["now_ms"].to_numpy(np.int64) - spent
        if state.exists:
            floor = np.maximum(floor, state.get[0])
        departs = np.maximum.accumulate(floor) + spent
        state.update((int(departs[-1]) + delay_ms,))
        yield pd.DataFrame({"host": key[0], "seq": rows["seq"], "departs_ms": departs})

    return arrivals.groupBy(host).applyInPandasWithState(pace, "host string, seq long, departs_ms long", "free long", "append", GroupStateTimeout.NoTimeout)


def stream_changes(observations: DataFrame) -> DataFrame:
    """Verdicts on a stream of ``(url, seq, status, etag, last_modified, content_hash)``; the state of a page is what was last read of it."""

    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        names = ("etag", "last_modified", "content_hash")
        at_first = state.get if state.exists else (None, None, None)
        status = rows["status"].to_numpy()
        readable = (status >= 200) & (status <= 299)
        # place of the last readable row before each row; 0 is what the state holds
        read = np.maximum.accumulate(np.r_[0, np.where(readable, np.arange(1, len(rows) + 1), 0)])
        before, now = {}, {}
        for name, held in zip(names, at_first):
            seen = pd.concat([pd.Series([held], dtype=object), rows[name].astype(object)], ignore_index=True)
            now[name], before[name] = seen.to_numpy()[1:], seen.to_numpy()[read[:-1]]
        known = {name: pd.notna(before[name]) for name in names}
        both = [known[name] & pd.notna(now[name]) for name in names]
        nothing = ~np.logical_or.reduce(list(known.values()))
        differ = [before[name] != now[name] for name in names]
        cases = [status == 304, ~readable, nothing, *both]
        changed = np.select(cases, [0, -1, 0, *(d.astype(int) for d in differ)], -1)
        via = np.select(cases, ["not-modified", "unknown", "unknown", "etag", "last-modified", "hash"], "unknown")
        if readable.any() or state.exists:
            last = int(read[-1]) - 1
            state.update(tuple(None if pd.isna(v) else v for v in (now[name][last] for name in names)) if last >= 0 else at_first)
        yield pd.DataFrame({"url": key[0], "seq": rows["seq"].to_numpy(), "changed": pd.array(changed == 1, "boolean"), "via": via}).assign(
            changed=lambda out: out["changed"].mask(changed < 0)
        )

    return observations.groupBy("url").applyInPandasWithState(
        judge, "url string, seq long, changed boolean, via string", "etag string, last_modified string, content_hash string", "append", GroupStateTimeout.NoTimeout
    )


def first_sightings(stream: DataFrame, key: str, time: str, keep: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them by ``keep``."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per window and group, late rows admitted up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"))

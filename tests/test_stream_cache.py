"""The cache as a stream: against a plain loop, against the batch form, and its state after expiry."""

import random

from textmill.operators import state
from textmill.streaming import cache

HOUR = 3_600_000
TTL, KEEP = 6 * HOUR, 30 * HOUR


def plain(visits):
    """What each visit gets, told case by case."""
    held, out = {}, {}
    for url, seq, now, space, mode, status, text, etag in sorted(visits, key=lambda v: (v[2], v[1])):
        space, mode, text = space or "native", mode or "normal", text or ""
        page = {k: v for k, v in held.setdefault(url, {}).items() if now - v[2] < KEEP}
        newest = max(page, key=lambda k: (page[k][2], k), default=None)
        own = page.get(space) if mode == "normal" else None
        got, source = text, "response" if text.strip() else "none"
        if mode == "offline":
            got, source = (page[newest][0], "cache") if newest else ("", "none")
        elif mode != "off" and own and now - own[2] < TTL:
            got, source = own[0], "cache"
        elif mode != "off" and own and own[1] and status == 304:
            held[url][space] = (own[0], own[1], now)
            got, source = own[0], "cache"
        elif mode != "off" and text.strip():
            held[url][space] = (text, etag, now)
        elif mode != "off" and newest:
            got, source = (own or page[newest])[0], "stale"
        out[seq] = (url, got if source != "none" else "", source)
    return out


def some_visits(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        status = rng.choice([200, 200, 304, 500, None])
        text = rng.choice([f"v{seq}", f"v{seq}", " ", None]) if status == 200 else rng.choice(["", None])
        url = None if rng.random() < 0.05 else rng.choice("abcd")
        mode = rng.choice(["normal"] * 5 + ["refresh", "offline", "off", None])
        rows.append((url, seq, (seq + 1) * HOUR // 2, rng.choice(["native", "pdf", None]), mode, status, text, rng.choice(["e", None])))
    return rows


def test_every_mode_equals_a_plain_loop_over_several_drains(spark):
    rows = some_visits(400)
    cuts = [0, 90, 91, 250, 400]
    parts = [spark.createDataFrame(rows[a:b], cache.VISIT) for a, b in zip(cuts, cuts[1:])]
    got = cache.drained(parts, lambda s: cache.stream_read_through(s, TTL, KEEP)).collect()
    want = plain(rows)
    assert len(got) == len(rows) and {r.seq: (r.url, r.text, r.source) for r in got} == want
    assert {s for _, _, s in want.values()} == {"cache", "response", "stale", "none"}


def test_last_visits_equal_the_batch_form(spark):
    stored = [(f"u{k}", k, (k + 1) * HOUR, "native", "normal", 200, f"t{k}", "e" if k % 2 else None) for k in range(20)]
    now = 21 * HOUR
    asked = [(f"u{k}", 100 + k, now, "native", "normal", (304, 200, 500)[k % 3], "new" if k % 3 == 1 else "", None) for k in range(25)]
    parts = [spark.createDataFrame(r, cache.VISIT) for r in (stored, asked)]
    got = cache.drained(parts, lambda s: cache.stream_read_through(s, TTL, 10**12)).where("seq >= 100")
    held = spark.createDataFrame([(u, n, t, e, at) for u, _, at, n, _, _, t, e in stored], "url string, namespace string, text string, etag string, cached_at long")
    answers = spark.createDataFrame([(v[0], v[5], v[6], None) for v in asked], "url string, status int, text string, etag string")
    want = state.read_through(answers.select("url"), held, answers, now, TTL)
    columns = ["url", "text", "source", "note", "cached_at", "store"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_state_shrinks_after_expiry(spark, tmp_path):
    folder, entries = str(tmp_path / "in"), []
    for rows in ([(f"u{k}", k, HOUR, "native", "normal", 200, "x", None) for k in range(50)], [("late", 99, 40 * HOUR, "native", "normal", 200, "y", None)], [("later", 100, 41 * HOUR, "native", "off", 200, "y", None)]):
        spark.createDataFrame(rows, cache.VISIT).coalesce(1).write.mode("append").parquet(folder)
        with cache.on_disk_state(spark):
            said = cache.stream_read_through(spark.readStream.schema(cache.VISIT).parquet(folder), TTL, KEEP)
            run = said.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            run.awaitTermination()
        entries.append(run.lastProgress.stateOperators[0].numRowsTotal)
    assert entries[-1] < entries[0] and entries[-1] <= 6
    assert spark.read.parquet(str(tmp_path / "out")).count() == 52


def test_an_empty_stream(spark):
    assert cache.drained([spark.createDataFrame([], cache.VISIT)], lambda s: cache.stream_read_through(s, TTL, KEEP)).count() == 0


def test_a_page_is_one_value_and_one_timer(spark, tmp_path):
    """Each call to the state and each row out of a worker has its price: one value and one timer a page, one row a page and batch."""
    visits = [(f"u{k}", 2 * k + i, (k + 1 + i) * HOUR, space, "normal", 200, "x", None) for k in range(20) for i, space in enumerate(("native", "pdf"))]
    spark.createDataFrame(visits, cache.VISIT).coalesce(1).write.parquet(str(tmp_path / "in"))
    with cache.on_disk_state(spark):
        said = cache.stream_read_through(spark.readStream.schema(cache.VISIT).parquet(str(tmp_path / "in")), TTL, KEEP)
        run = said.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert run.lastProgress.stateOperators[0].numRowsTotal == 20
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40

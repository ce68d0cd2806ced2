"""Operators that carry state between rows: change detection, cache, pacing, crawling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions.hashing import fnv1a64
from textmill.functions.structure import is_allowed
from textmill.functions.text import _col
from textmill.functions.urls import canonicalize_url, domain_of, host_of, scheme_of
from textmill.operators.cuts import written

# -- change -------------------------------------------------------------------------------------


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def fingerprint(responses: DataFrame) -> DataFrame:
    """What an observation remembers: ``url, etag, last_modified, content_hash, bytes, status`` (hash of successes only)."""
    ok = F.col("status").between(200, 299)
    return responses.select(
        "url",
        F.nullif(F.col("etag"), F.lit("")).alias("etag"),
        F.nullif(F.col("last_modified"), F.lit("")).alias("last_modified"),
        F.when(ok & (F.length("body") > 0), content_hash("body")).alias("content_hash"),
        F.coalesce(F.length("body"), F.lit(0)).cast("bigint").alias("bytes"),
        "status",
        *[c for c in ("seq", "ts", "fetched_at") if c in responses.columns],
    )


def verdict(status: Column, now: Column, before: Column) -> Column:
    """``STRUCT<changed, via, note>`` of an observation against the previous one; ``changed`` is null where nobody can tell.

    ``now`` and ``before`` are structs with ``etag, last_modified, content_hash``.
    """
    yes_no, text = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    told = lambda changed, via, note=text: F.struct(changed.alias("changed"), F.lit(via).alias("via"), note.alias("note"))
    both = lambda f: before[f].isNotNull() & now[f].isNotNull()
    nothing = before.isNull() | (before["etag"].isNull() & before["last_modified"].isNull() & before["content_hash"].isNull())
    return (
        F.when(status == 304, told(F.lit(False), "not-modified"))
        .when(~status.between(200, 299), told(yes_no, "unknown", F.concat(F.lit("status "), status)))
        .when(nothing, told(F.lit(False), "unknown", F.lit("no previous observation — this is the baseline.")))
        .when(both("etag"), told(before["etag"] != now["etag"], "etag"))
        .when(both("last_modified"), told(before["last_modified"] != now["last_modified"], "last-modified"))
        .when(both("content_hash"), told(before["content_hash"] != now["content_hash"], "hash"))
        .otherwise(told(yes_no, "unknown", F.lit("nothing comparable between the two observations — store contentHash to make this answerable.")))
    )


def changes(observations: DataFrame, order: str = "seq") -> DataFrame:
    """Each observation of ``(url, status, etag, last_modified, content_hash, order)`` against the one before it that could be read."""
    known = F.struct("etag", "last_modified", "content_hash")
    earlier = Window.partitionBy("url").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("status").between(200, 299), known), ignorenulls=True).over(earlier)
    judged = observations.withColumn("_before", seen).withColumn("_v", verdict(F.col("status"), known, F.col("_before")))
    return judged.select(*observations.columns, F.col("_v.changed").alias("changed"), F.col("_v.via").alias("via"), F.col("_v.note").alias("note"))


# -- cache --------------------------------------------------------------------------------------

NAMESPACES = ("native", "firecrawl", "pdf", "doc")


def with_cache_key(df: DataFrame, url: str = "url", language: Column | None = None, namespace: Column | None = None, out: str = "key") -> DataFrame:
    """Append domain and a 64-bit hash of canonical address, language and extractor."""
    domain = F.coalesce(F.nullif(F.regexp_replace(domain_of(url), "(?i)[^a-z0-9.-]", "_"), F.lit("")), F.lit("url"))
    parts = [F.coalesce(language, F.lit("")) if language is not None else F.lit(""), namespace if namespace is not None else F.lit("native")]
    named = df.withColumn("_canonical", canonicalize_url(url)).withColumn("_whole", F.concat(F.col("_canonical"), F.lit("\0"), parts[0], F.lit("\0"), parts[1]))
    return named.withColumn(out, F.concat(domain, F.lit("-"), F.regexp_replace(fnv1a64("_whole"), "^0+(?=.)", ""))).drop("_canonical", "_whole")


def is_fresh(cached_at: Column | str, now: Column, ttl_ms: int) -> Column:
    """Strictly younger than the time to live; a time to live of 0 means never."""
    return F.coalesce(now - _col(cached_at) < ttl_ms, F.lit(False))


def cache_stats(cache: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """One row: entries, bytes, fresh, stale, oldest, newest."""
    fresh = is_fresh("cached_at", F.lit(now_ms), ttl_ms)
    return cache.where(F.col("cached_at").isNotNull()).agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(fresh).alias("fresh"),
        F.count_if(~fresh).alias("stale"),
        F.min("cached_at").alias("oldest"),
        F.max("cached_at").alias("newest"),
    )


def cache_clean(cache: DataFrame, now_ms: int, ttl_ms: int, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(survivors, removed)``."""
    fresh = is_fresh("cached_at", F.lit(now_ms), ttl_ms) & F.lit(not everything)
    return cache.where(fresh), cache.where(~fresh)


def read_through(requests: DataFrame, cache: DataFrame, responses: DataFrame, now_ms: int, ttl_ms: int, offline: bool = False, refresh: bool = False) -> DataFrame:
    """Serve ``requests(url)`` from ``cache(url, namespace, text, etag, cached_at)`` or ``responses(url, status, text, etag)``.

    A fresh entry is served; a stale one with a validator is confirmed by 304
    and re-stamped; otherwise a readable response wins and is stored; failing
    that the stale copy is served with a note. Offline serves the newest entry
    of any namespace. Of entries of equal age that with the least ``seq``, a
    column that ``cache`` may have, counts as the newest. Columns: ``url, text,
    source, note, cached_at, store`` (whether the entry is to be written back).
    """
    newer = F.struct("cached_at", -F.col("seq")) if "seq" in cache.columns else F.col("cached_at")
    newest = cache.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("url").agg(F.max_by(F.struct(F.col("text").alias("t"), F.col("etag").alias("e"), F.col("cached_at").alias("at")), newer).alias("hit"))
    got = responses.groupBy("url").agg(F.first(F.struct(F.col("status").alias("status"), F.col("text").alias("t"))).alias("got"))
    joined = requests.select("url").join(newest, "url", "left").join(got, "url", "left")
    hit, answer = F.col("hit"), F.col("got")
    fresh = is_fresh(hit["at"], F.lit(now_ms), ttl_ms) & F.lit(not refresh)
    confirmed = (answer["status"] == 304) & hit["e"].isNotNull() & F.lit(not refresh)
    readable = F.trim(F.coalesce(answer["t"], F.lit(""))) != ""
    none = F.lit(None).cast("string")
    row = lambda text, source, note, at, store: F.struct(text.alias("text"), F.lit(source).alias("source"), note.alias("note"), at.cast("bigint").alias("cached_at"), F.lit(store).alias("store"))
    now = F.lit(now_ms)
    if offline:
        served = F.when(hit.isNotNull(), row(hit["t"], "cache", none, hit["at"], False)).otherwise(row(F.lit(""), "none", F.concat(F.lit("Offline: "), F.col("url"), F.lit(" is not in the cache")), F.lit(None), False))
    else:
        failed = F.concat(F.col("url"), F.lit(" returned "), F.coalesce(F.nullif(answer["status"], F.lit(0)).cast("string"), F.lit("no response")), F.lit("; served the cached copy"))
        served = (
            F.when(fresh, row(hit["t"], "cache", none, hit["at"], False))
            .when(confirmed, row(hit["t"], "cache", none, now, True))
            .when(readable, row(answer["t"], "response", none, now, True))
            .when(hit.isNotNull(), row(hit["t"], "stale", failed, hit["at"], False))
            .otherwise(row(F.lit(""), "none", F.concat(F.lit("status "), F.coalesce(answer["status"], F.lit(0))), F.lit(None), False))
        )
    return joined.withColumn("_s", served).select("url", "_s.*")


# -- pacing -------------------------------------------------------------------------------------


def host_slots(arrivals: DataFrame, host: str = "host", seq: str = "seq", now_ms: str = "now_ms", delay_ms: str = "delay_ms", back_off_ms: str | None = None) -> DataFrame:
    """When each request of a host may leave: ``departs_ms`` and ``waits_ms``.

    The recurrence departs = max(now, previous departure + its delay) in closed
    form: a running maximum of ``now`` less the delays before it. A back-off
    pushes the next slot to ``now + back_off`` at least.
    """
    before = Window.partitionBy(host).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(host).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.coalesce(F.sum(delay_ms).over(before), F.lit(0))
    asked = arrivals.withColumn("_spent", spent).withColumn("_floor", F.col(now_ms) - F.col("_spent"))
    if back_off_ms:
        pushed = F.lag(F.col(now_ms) + F.coalesce(F.col(back_off_ms), F.lit(0)) - F.col("_spent") - F.col(delay_ms)).over(Window.partitionBy(host).orderBy(seq))
        asked = asked.withColumn("_floor", F.greatest("_floor", F.coalesce(pushed, F.col("_floor"))))
    departs = F.max("_floor").over(upto) + F.col("_spent")
    return asked.withColumn("departs_ms", departs.cast("bigint")).withColumn("waits_ms", (F.col("departs_ms") - F.col(now_ms)).cast("bigint")).drop("_spent", "_floor")


# -- crawl --------------------------------------------------------------------------------------


def origin_of(c: Column | str) -> Column:
    port = F.regexp_extract(F.call_function("try_parse_url", _col(c), F.lit("AUTHORITY")), r":(\d+)$", 1)
    return F.concat(scheme_of(c), F.lit("://"), host_of(c), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")))


#: Rows of a crawl's table that are told to every task; more of them are shuffled, for files of addresses are a fraction of their rows.
TOLD_ROWS = 50_000


def _told(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= TOLD_ROWS else rows.hint("merge")


def crawl_sites(
    pages: DataFrame,
    links: DataFrame,
    seeds: DataFrame,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    max_pages: int = 20,
    max_depth: int = 2,
    cross_origin: bool = False,
) -> dict[str, DataFrame]:
    """Breadth-first walks over stored pages from many ``seeds(seed)`` at once, a few joins per level for all of them.

    ``pages(url, title, text)``, ``links(url, pos, link)``,
    ``robots(seed, robots STRUCT)``, ``sitemaps(seed, pos, loc)``. Returns
    ``pages`` (``seed, url, depth, place, title, text``), ``pending`` and
    ``disallowed`` (``seed, url, depth``).

    Each walk is first in, first out: level, place of the parent, place of the
    link; the entries of a sitemap come before the links of the seed. An
    address is met once a walk per canonical form. ``max_pages`` counts
    readable pages; what a walk has not come to when they are read is pending.
    Levels are cut in the shared folder, and so are pages and links with their
    canonical forms, made once. What reaches the driver to be told to all tasks
    is ``TOLD_ROWS`` rows at most of any table. A walk's part of a level is bounded by
    the links of ``max_pages`` pages and its sitemap, so windows go by walk.
    """
    most = max(1, max_pages)
    seeds = written(seeds.where(F.col("seed").isNotNull()).select("seed").distinct(), "crawl-seeds")
    walks = n_next = n_seen = seeds.count()
    known = written(pages.withColumn("_key", canonicalize_url("url")).dropDuplicates(["_key"]).select("_key", "title", "text"), "crawl-pages")
    out = written(links.select(canonicalize_url("url").alias("_from"), "pos", "link"), "crawl-links")
    at_home = lambda url: F.lit(True) if cross_origin else F.coalesce(origin_of(url) == origin_of("seed"), F.lit(False))
    columns = ["seed", "url", "depth", "p1", "p2", "_key"]
    item = lambda rows, url, depth, p1, p2: rows.select("seed", F.col(url).alias("url"), F.lit(depth).alias("depth"), p1.cast("long").alias("p1"), p2.cast("long").alias("p2"), canonicalize_url(url).alias("_key"))
    frontier = written(item(seeds, "seed", 0, F.lit(0), F.lit(0)), "crawl-next")
    seen, budget = frontier.select("seed", "_key"), seeds.withColumn("left", F.lit(most))
    rules = None if robots is None else written(robots.select("seed", "robots").dropDuplicates(["seed"]), "crawl-rules")
    by_seed = Window.partitionBy("seed")
    found: dict[str, list[DataFrame]] = {"pages": [], "pending": [], "disallowed": []}
    for depth in range(max(0, max_depth) + 1):
        hit = known.join(F.broadcast(frontier.select("_key")), "_key", "left_semi") if n_next <= TOLD_ROWS else known
        read = frontier.join(_told(hit, n_next), "_key", "left").withColumn("place", F.row_number().over(by_seed.orderBy("p1", "p2")))
        if rules is None:
            read = read.withColumn("_ok", F.lit(True))
        else:
            ruled = read.join(_told(rules, walks), "seed", "left")
            read = ruled.withColumn("_ok", F.col("robots").isNull() | is_allowed("robots", "url")).drop("robots")
        read = read.withColumn("_page", F.col("_ok") & F.coalesce(F.length("text") > 0, F.lit(False)))
        before = F.sum(F.col("_page").cast("int")).over(by_seed.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        read = read.join(_told(budget, walks), "seed").withColumn("_reached", F.coalesce(before, F.lit(0)) < F.col("left")).drop("left")
        read = written(read, "crawl-level")
        taken = read.where(F.col("_reached") & F.col("_page"))
        found["pages"].append(taken.select("seed", "url", "depth", "place", "title", "text"))
        found["disallowed"].append(read.where(F.col("_reached") & ~F.col("_ok")).select("seed", "url", "depth"))
        found["pending"].append(read.where(~F.col("_reached")).select("seed", "url", "depth"))
        if depth == max(0, max_depth):
            break
        spent = taken.groupBy("seed").agg(F.count(F.lit(1)).alias("_n"))
        budget = written(budget.join(_told(spent, walks), "seed", "left").select("seed", (F.col("left") - F.coalesce("_n", F.lit(0))).cast("int").alias("left")), "crawl-budget")
        asks = _told(taken.select("seed", "_key", "place"), n_next)
        following = out.join(asks, F.col("_key") == F.col("_from")).where(at_home("link")).select("seed", F.col("link").alias("url"), F.lit(depth + 1).alias("depth"), F.col("place").cast("long").alias("p1"), F.col("pos").cast("long").alias("p2"), canonicalize_url("link").alias("_key"))
        if sitemaps is not None and depth == 0:
            listed = sitemaps.join(_told(seeds, walks), "seed").where(at_home("loc"))
            following = following.unionByName(item(listed, "loc", 1, F.lit(-1), F.col("pos")))
        first = Window.partitionBy("seed", "_key").orderBy("p1", "p2")
        once = following.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select(*columns)
        fresh = written(once.join(_told(seen, n_seen), ["seed", "_key"], "left_anti").join(_told(budget, walks), "seed"), "crawl-next")
        found["pending"].append(fresh.where("left <= 0").select("seed", "url", "depth"))
        frontier = fresh.where("left > 0").select(*columns)
        n_next = frontier.count()
        if not n_next:
            break
        n_seen += fresh.count()
        seen = seen.unionByName(fresh.select("seed", "_key"))
    return {kind: reduce(DataFrame.unionByName, parts) for kind, parts in found.items()}


def crawl(pages: DataFrame, links: DataFrame, seed: str, robots: DataFrame | None = None, sitemap: DataFrame | None = None, max_pages: int = 20, max_depth: int = 2, cross_origin: bool = False) -> dict[str, DataFrame]:
    """``crawl_sites`` from one seed, with one row of ``robots(robots STRUCT)`` and ``sitemap(pos, loc)``; its tables without ``seed``."""
    mine = lambda rows: None if rows is None else rows.withColumn("seed", F.lit(seed))
    seeds = pages.sparkSession.createDataFrame([(seed,)], "seed string")
    found = crawl_sites(pages, links, seeds, mine(robots), mine(sitemap), max_pages, max_depth, cross_origin)
    return {kind: rows.drop("seed") for kind, rows in found.items()}

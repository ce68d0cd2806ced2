"""What sites publish about themselves, read from stored responses: robots rules, sitemaps, feeds, JSON answers.

``stored(url, status, content_type, bytes)`` may hold an address more than once;
the successful row with the longest body counts. A failed, blank or missing
answer is the same as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.structure import parse_feed_udf, parse_robots_udf, parse_sitemap_udf
from textmill.operators.state import origin_of
from textmill.sources.bytes import decoded

#: How many sitemap documents of a site are read unless told otherwise.
MOST_SITEMAPS = 3


def bodies(stored: DataFrame) -> DataFrame:
    """``url, body``: one readable body per address."""
    good = stored.where(F.col("status").between(200, 299) & (F.octet_length("bytes") > 0))
    one = good.groupBy("url").agg(F.max_by(F.struct("bytes", "content_type"), F.struct(F.octet_length("bytes"), "bytes")).alias("b"))
    return one.select("url", decoded("b.bytes", F.coalesce("b.content_type", F.lit(""))).alias("body")).where(F.trim("body") != "")


def robots_of(pages: DataFrame, stored: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``pages`` with ``robots``, the rules of each page's origin; without a readable file, or for no web address, they allow all.

    Each origin's file is parsed once. An origin is a join key of the pages, the
    parsed rules are the narrow side: AQE splits a hot origin or broadcasts the rules.
    """
    rules = bodies(stored.where(F.col("url").endswith("/robots.txt"))).select(F.col("url").alias("_file"), parse_robots_udf("body", F.lit(agent)).alias("_rules"))
    nothing = F.from_json(F.lit('{"rules":[],"sitemaps":[],"absent":true}'), "rules array<struct<allow:boolean,path:string>>,crawl_delay_ms bigint,sitemaps array<string>,absent boolean")
    joined = pages.withColumn("_file", F.concat(origin_of(url), F.lit("/robots.txt"))).join(rules, "_file", "left")
    return joined.withColumn("robots", F.coalesce("_rules", nothing)).drop("_file", "_rules")


def sitemaps_of(sites: DataFrame, stored: DataFrame, most: int = MOST_SITEMAPS, url: str = "url", named: str = "sitemaps") -> DataFrame:
    """Page entries of at most ``most`` sitemap documents a site, first in, first out: ``url, doc_no, doc, pos, loc, lastmod``.

    The queue starts with the addresses in ``named`` (those of the robots file;
    null for none) and ``/sitemap.xml``; an index appends its own. Every round
    advances all sites at once by one join, so there are ``most`` of them.
    An unreadable document counts towards ``most``.
    """
    most = max(1, most)
    read = bodies(stored).select(F.col("url").alias("_at"), parse_sitemap_udf("body").alias("_map"))
    start = F.concat(F.coalesce(named, F.array().cast("array<string>")), F.array(F.concat(origin_of(url), F.lit("/sitemap.xml"))))
    queued = sites.where(F.call_function("try_parse_url", F.col(url), F.lit("HOST")).isNotNull()).select(F.col(url).alias("url"), F.array_distinct(start).alias("queue")).dropDuplicates(["url"])
    indexes = read.where(F.size("_map.sitemaps") > 0).select("_at", F.col("_map.sitemaps").alias("_more"))
    for i in range(most - 1):
        told = queued.withColumn("_at", F.get("queue", F.lit(i))).join(indexes, "_at", "left")
        queued = told.select("url", F.array_distinct(F.concat("queue", F.coalesce("_more", F.array().cast("array<string>")))).alias("queue"))
    visits = queued.select("url", F.posexplode(F.slice("queue", 1, most)).alias("doc_no", "doc"))
    entries = visits.join(read, F.col("doc") == F.col("_at")).select("url", "doc_no", "doc", F.posexplode("_map.urls").alias("pos", "u"))
    return entries.select("url", "doc_no", "doc", "pos", "u.loc", "u.lastmod")


def feeds_of(stored: DataFrame) -> DataFrame:
    """``url, feed``: the parsed feed of every stored address; ``feed.kind`` is null for what is none."""
    return bodies(stored).select("url", parse_feed_udf("body").alias("feed"))


def json_answers(stored: DataFrame) -> DataFrame:
    """``url, ok, status, data, text``: the body as a VARIANT, or as text where it does not parse; both null for an empty one."""
    body = F.nullif(decoded("bytes", F.coalesce("content_type", F.lit(""))), F.lit(""))
    told = stored.select("url", "status", body.alias("body"))
    data = F.try_parse_json("body")
    return told.select("url", F.col("status").between(200, 299).alias("ok"), "status", data.alias("data"), F.when(data.isNull(), F.col("body")).alias("text"))

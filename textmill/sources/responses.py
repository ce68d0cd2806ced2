"""HTTP responses as a data source, and what their headers say.

``responses`` is a Python data source: one partition per host, failures as rows
(``ok = false``), never as failed tasks. Where there is no network, tables of
stored responses with the same schema take its place.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textmill.functions.lexicon import DEAD_LINK_STATUS
from textmill.functions.text import _col

SCHEMA = (
    "url STRING, ok BOOLEAN, status INT, content_type STRING, bytes BINARY, final_url STRING, etag STRING, "
    "last_modified STRING, rate_limited BOOLEAN, retry_after_ms BIGINT, error STRING"
)
# What is tried again, how often, how long and how large.
RETRY_STATUS, ATTEMPTS, TIMEOUT_S, MAX_BYTES, RETRY_CAP_MS = (429, 502, 503, 504), 2, 20, 4 << 20, 5000


def detect_rate_limited(status: Column | str, headers: Column | str) -> Column:
    """429, or 403 with an exhausted quota header."""
    left = F.try_element_at(_col(headers), F.lit("x-ratelimit-remaining"))
    return (_col(status) == 429) | ((_col(status) == 403) & F.coalesce(left == "0", F.lit(False)))


def retry_after_ms(header: Column | str, now: Column | None = None, cap_ms: int = RETRY_CAP_MS) -> Column:
    """Seconds or a date to a delay within 0 and ``cap_ms``; null when there is no usable hint."""
    h = _col(header)
    seconds = h.try_cast("double") * 1000
    when = F.try_to_timestamp(F.regexp_replace(h, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ahead = (F.unix_millis(when) - F.unix_millis(now if now is not None else F.current_timestamp())).cast("double")
    return F.least(F.greatest(F.coalesce(seconds, ahead), F.lit(0.0)), F.lit(float(cap_ms))).cast("bigint")


def is_dead_link(status: Column | str) -> Column:
    return _col(status).isin(*DEAD_LINK_STATUS)


def throttle_reason(status: Column | str) -> Column:
    """``STRUCT<throttled, why>`` for a failed request."""
    s = _col(status)
    why = (
        F.when(s.isin(429, 503), F.concat(F.lit("rate-limited (HTTP "), s, F.lit(")")))
        .when(s == 403, F.lit("blocked this client as automated traffic (HTTP 403)"))
        .otherwise(F.concat(F.lit("unreachable (status "), s, F.lit(")")))
    )
    return F.struct(s.isin(429, 503, 403).alias("throttled"), why.alias("why"))


def revalidation_headers(etag: Column | str, last_modified: Column | str) -> Column:
    """Conditional request headers out of the validators that are there."""
    both = F.create_map(F.lit("if-none-match"), F.nullif(_col(etag), F.lit("")), F.lit("if-modified-since"), F.nullif(_col(last_modified), F.lit("")))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def fetch_one(
    url: str,
    timeout: float = TIMEOUT_S,
    max_bytes: int = MAX_BYTES,
    agent: str = "textmill",
    method: str = "GET",
    body: str | None = None,
    headers: dict[str, str] | None = None,
    retries: int = ATTEMPTS - 1,
) -> tuple:
    """One request as a row of ``SCHEMA``; whatever goes wrong is in the row.

    A body is sent as JSON unless ``headers`` say otherwise; their names are
    lower-cased and win over the defaults. Transient statuses and lost
    connections are tried again ``retries`` times.
    """
    last: tuple = ()
    attempts = 1 + max(0, retries)
    sent = {"user-agent": agent, **({} if body is None else {"content-type": "application/json"}), **{k.lower(): v for k, v in (headers or {}).items()}}
    data = None if body is None else body.encode()
    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=sent, method=method), timeout=timeout) as r:  # noqa: S310
                h, declared = r.headers, int(r.headers.get("content-length") or 0)
                got = b"" if declared > max_bytes else r.read(max_bytes)
                error = f"body of {declared} bytes is over {max_bytes}" if declared > max_bytes else None
                return (url, error is None, r.status, h.get("content-type"), got, r.url, h.get("etag"), h.get("last-modified"), False, None, error)
        except urllib.error.HTTPError as e:
            limited = e.code == 429 or (e.code == 403 and e.headers.get("x-ratelimit-remaining") == "0")
            hint = e.headers.get("retry-after")
            wait = min(int(hint) * 1000, RETRY_CAP_MS) if hint and hint.isdigit() else None
            last = (url, False, e.code, e.headers.get("content-type"), b"", url, e.headers.get("etag"), e.headers.get("last-modified"), limited, wait, str(e))
            if e.code not in RETRY_STATUS:
                return last
            if attempt + 1 < attempts:
                time.sleep((wait or 500) / 1000)
        except (OSError, ValueError) as e:
            last = (url, False, 0, None, b"", url, None, None, False, None, str(e))
    return last


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(urls)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.timeout, self.max_bytes = float(options.get("timeout", TIMEOUT_S)), int(options.get("maxbytes", MAX_BYTES))
        headers = {k.removeprefix("header."): v for k, v in options.items() if k.startswith("header.")}
        self.request = {"method": options.get("method", "GET").upper(), "body": options.get("body"), "headers": headers, "retries": int(options.get("retries", ATTEMPTS - 1))}

    def partitions(self) -> list[InputPartition]:
        by_host: dict[str, list[str]] = {}
        for u in self.urls:
            by_host.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Host(us) for us in by_host.values()] or [_Host([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for u in partition.value:
            yield fetch_one(u, self.timeout, self.max_bytes, **self.request)


class HttpResponses(DataSource):
    """``spark.read.format("responses").option("urls", one per line).load()``

    Further options: ``timeout``, ``maxBytes``, ``method``, ``body`` (JSON),
    ``retries`` and ``header.NAME``.
    """

    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpResponses)

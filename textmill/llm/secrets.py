"""Secret scans with multipart credential linking.

Base spans: assignments to secret-like names, access key identifiers, long hex
runs. On top, weak parts (account names, short or unnamed secrets, endpoints)
are collected; an interval join over scopes, by look-ups in the sorted starts
and ends of a scope's parts, reports a weak part only when its complement lies
near it in the same scope, beside, around or inside: a secret needs an
identifier, an identifier needs a secret, an endpoint needs both. One value is
never its own complement.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import narrow_batches

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
BASE = ("assign", "access", "hex")

_LOGIN = re.compile(r"""\b(?:user(?:_?name)?|login|account(?:_id)?|client_?id|access_?key(?:_?id)?)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9_.@+-]{3,}+)""", re.I | re.A)
_WEAK = re.compile(r"""\b(?:pwd|pass(?:word|wd)?|secret|token|credential|private_?key|api_?key|auth)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=!@#$%^&*-]{6,}+)""", re.I | re.A)
_BLOB = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[A-Z0-9+/]*+[a-z])(?=[a-z0-9+/]*+[A-Z])[A-Za-z0-9+/]{40,}+={0,2}+(?![A-Za-z0-9+/=])", re.A)
_LONG = re.compile(r"[A-Za-z0-9+/]{40}")
_POINT = re.compile(r"""\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}+|\b(?:host|endpoint|server)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9_.:-]{4,}+)""", re.I | re.A)
_CREDENTIAL = re.compile(r"""://([^\s"'<>/:@?#]*+):([^\s"'<>/@?#]++)@""")
KINDS = (*BASE, "login", "weak", "endpoint")


#: Strings of which every match of a pattern has one, in lower case: a text without them is not searched.
_SIGNS = {
    _ASSIGN: ("password", "passwd", "secret", "token", "apikey", "api_key"),
    _LOGIN: ("user", "login", "account", "client", "access"),
    _WEAK: ("pwd", "pass", "secret", "token", "credential", "private", "api", "auth"),
    _POINT: ("://", "host", "endpoint", "server"),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: tuple[int, int] | None = None  #: where the name, the secret or the host itself stands; none for an address as a whole


def _matches(pattern: re.Pattern, text: str, lower: str) -> Iterator[re.Match]:
    return pattern.finditer(text) if any(sign in lower for sign in _SIGNS[pattern]) else iter(())


def base_spans(text: str) -> list[Span]:
    """Strong findings, leftmost and non-overlapping within each kind."""
    found = [Span("assign", *m.span(), m.span(2)) for m in _matches(_ASSIGN, text, text.lower()) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [Span("access", *m.span(), m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [Span("hex", *m.span(), m.span()) for m in _HEX.finditer(text)]
    return found


def weak_parts(text: str) -> list[Span]:
    """Named and unnamed weak parts; the user and the password of an address are an identifier and a secret."""
    lower = text.lower()
    found = [Span("login", *m.span(), m.span(1)) for m in _matches(_LOGIN, text, lower)]
    found += [Span("weak", *m.span(), m.span(1)) for m in _matches(_WEAK, text, lower)]
    if _LONG.search(text):
        found += [Span("weak", *m.span(), m.span()) for m in _BLOB.finditer(text)]
    found += [Span("endpoint", *m.span(), m.span(1) if m[1] else None) for m in _matches(_POINT, text, lower)]
    for m in _CREDENTIAL.finditer(text):
        found += [Span(kind, *m.span(k), m.span(k)) for k, kind in ((1, "login"), (2, "weak")) if m[k]]
    return found


def scopes_of(spans: list[Span], reach: int) -> list[list[Span]]:
    """Spans, by start, in scopes: a scope ends where the next span starts over ``reach`` code points after all before it."""
    groups: list[list[Span]] = []
    until = -1
    for s in sorted(spans, key=lambda s: (s.start, s.end)):
        if groups and s.start <= until:
            groups[-1].append(s)
        else:
            groups.append([s])
        until = max(until, s.end + reach)
    return groups


class Near:
    """Parts that answer whether one of them lies at most ``reach`` code points from a span, beside, around or inside it."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(s.start for s in spans), sorted(s.end for s in spans)
        self.values = sorted(s.value[0] for s in spans), sorted(s.value[1] for s in spans)

    @staticmethod
    def _meeting(ends_of: tuple[list[int], list[int]], start: int, end: int) -> int:
        """How many intervals start by ``end`` and do not end before ``start``."""
        starts, ends = ends_of
        return bisect_right(starts, end) - bisect_left(ends, start)

    def complements(self, span: Span, reach: int) -> bool:
        """Some part is near and its value shares no character with that of ``span``: look-ups in sorted lists.

        Parts whose values overlap are near as well, so the two counts differ by the parts that complement.
        """
        near = self._meeting(self.spans, span.start - reach, span.end + reach)
        same = self._meeting(self.values, span.value[0] + 1, span.value[1] - 1) if span.value else 0
        return near > same


def linked(text: str, base: list[Span], reach: int = 120) -> list[Span]:
    """The weak parts that complementary parts of the same scope make credible."""
    weak = weak_parts(text)
    if not weak:
        return []
    taken = {(s.start, s.end) for s in base}
    credible = set()
    for scope in scopes_of([*base, *weak], reach):
        names = Near([s for s in scope if s.kind in ("access", "login")])
        secrets = Near([s for s in scope if s.kind in ("assign", "hex", "weak")])
        for s in scope:
            if s.kind in BASE or (s.start, s.end) in taken:
                continue
            by_name = s.kind != "login" and names.complements(s, reach)
            by_secret = s.kind != "weak" and secrets.complements(s, reach)
            if (s.kind == "login" and by_secret) or (s.kind == "weak" and by_name) or (s.kind == "endpoint" and by_name and by_secret):
                credible.add(s)
    return sorted(credible, key=lambda s: (s.start, s.end, s.kind))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 120) -> DataFrame:
    """Per document ``doc_id`` and ``found``: an array of (kind, start, end), code points, end exclusive, base and linked spans.

    Spans come by start, then kind in the order of ``KINDS`` (ties). Null texts
    are empty: no spans. Whole texts are read, of any length, in time that grows
    with the length but for the sorting of the spans; rows are independent, so
    repeated rows and null ids come back as they are; an empty table gives none;
    other columns, whatever their names, play no part.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = sorted([*base, *linked(text, base, reach)], key=lambda s: (s.start, KINDS.index(s.kind), s.end))
                found.append([{"kind": s.kind, "start": s.start, "end": s.end} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(span))], names=["doc_id", "found"])

    rows = narrow_batches(docs, id_col, text_col).toDF("doc_id", "text")
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(scan, f"doc_id {id_type}, found array<struct<kind:string,start:long,end:long>>")


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """Counts and digests of ``find_secrets``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs, **options).select("doc_id", *map(of, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))

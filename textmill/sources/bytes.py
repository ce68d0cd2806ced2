"""Response bytes to text: character sets, PDF text layers, office formats, and the router over them."""

from __future__ import annotations

import codecs
import contextlib
import re
import zlib
from collections.abc import Iterator
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.batched import per_value
from textmill.functions.elements import tags
from textmill.functions.markup import assess_text, canonical_link_udf, html_title_udf, junk_reason, main_html, html_to_text, meta_description_udf, strings
from textmill.functions.text import _col
from textmill.functions.urls import looks_like_pdf

# Labels that are read as Windows-1252.
WESTERN = "windows-1252 cp1252 cp-1252 x-cp1252 ansi_x3.4-1968 iso-8859-1 iso8859-1 latin1 l1 us-ascii ascii".split()
# Office formats by extension and by content type; only CSV may be read as text.
DOC_EXTENSIONS = "doc docx docm odt rtf ppt pps pot pptx pptm ppsx ppsm odp xls xlsx xlsm xlsb ods epub csv".split()
DOC_CONTENT_TYPES = """
    application/msword application/vnd.openxmlformats-officedocument.wordprocessingml.document
    application/vnd.ms-word.document.macroenabled.12 application/vnd.oasis.opendocument.text application/rtf text/rtf
    application/vnd.ms-powerpoint application/vnd.openxmlformats-officedocument.presentationml.presentation
    application/vnd.oasis.opendocument.presentation application/vnd.ms-excel
    application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.ms-excel.sheet.binary.macroenabled.12
    application/vnd.oasis.opendocument.spreadsheet application/epub+zip text/csv
""".split()
#: Rungs of the PDF ladder, in order; those that need tools this engine does not ship are given as columns.
PDF_RUNGS = ("pdf-inspector", "anydoc", "firecrawl", "pdftotext", "native", "ocr")
#: Rungs of the office ladder; there is none of its own, so without a converter's text a document is refused.
DOC_RUNGS = ("anydoc", "firecrawl")
NO_CONVERTER = "no converter for this format"


_LABEL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_:.+-")


def charset_parameter(value: str | None) -> str | None:
    """The value of the ``charset`` parameter of a header or attribute, in lower case."""
    _, named, rest = (value or "").lower().partition("charset")
    rest = rest.lstrip()
    label = "".join(takewhile(_LABEL.__contains__, rest[1:].lstrip().lstrip("\"'"))) if named and rest.startswith("=") else ""
    return label or None


def declared_in(head: str | None) -> str | None:
    """The label in a ``<meta>`` of the first 4096 characters: an attribute of its own, or a parameter of the content."""
    said = (charset_parameter(f"charset={a['charset']}") if a.get("charset") else charset_parameter(a.get("content")) for a in tags((head or "")[:4096], "meta"))
    return next(filter(None, said), None)


def content_type_charset(c: Column | str) -> Column:
    """``charset_parameter`` of a column."""
    after = F.ltrim(F.get(F.split(F.lower(_col(c)), "charset", 2), F.lit(1)))
    given = F.regexp_replace(F.ltrim(F.substring(after, 2, 200)), "^[\"']+", "")
    return F.when(after.startswith("="), F.nullif(F.regexp_extract(given, "^[a-z0-9_:.+-]+", 0), F.lit("")))


#: ``declared_in`` of a column.
html_charset = per_value("string", declared_in)


def _western(data: bytes) -> str:
    """Windows-1252 in which the five unassigned bytes stand for their own control characters."""
    return data.decode("cp1252", errors="textmill-c1")


codecs.register_error("textmill-c1", lambda e: (e.object[e.start : e.end].decode("latin-1"), e.end))


def decode_body(data: bytes, content_type: str | None = "") -> str:
    """By byte-order mark, then declared label, then ``<meta>``, then UTF-8; malformed bytes become U+FFFD."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    name = charset_parameter(content_type) or declared_in(data[:4096].decode("latin-1")) or "utf-8"
    if name in WESTERN:
        return _western(data)
    try:
        return data.decode(name, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def decoded(data: Column | str, content_type: Column | str) -> Column:
    return per_value("string", lambda b, t: decode_body(bytes(b), t))(data, content_type)


# -- PDF text layer -----------------------------------------------------------------------------

# Fixed values of the page description language: delimiters, escapes of literal strings, operators that show or place text.
_LEXEME = re.compile(rb"[\x00\t\n\f\r ]+|%[^\r\n]*|<<|>>|<[^<>]*>|[()\[\]{}]|/?[^\x00\t\n\f\r ()<>\[\]{}/%]+|.", re.S)
_ESCAPED = {ord(k): v for k, v in {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": "", "\r": ""}.items()}
_OPENS_LINE = {b"'", b'"'}
_SHOWS = {b"Tj", b"TJ"} | _OPENS_LINE
#: A shift to the right by so many thousandths of the font size is a blank.
GAP = 100


def _literal(data: bytes, at: int) -> tuple[str, int]:
    """The string whose opening parenthesis is just before ``at``, inner pairs counted, and where it ends."""
    out, depth, n = [], 1, len(data)
    while at < n:
        c = data[at]
        at += 1
        if c == 0x5C and at < n:
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            out.append(chr(int(octal[0], 8) & 255) if octal else _ESCAPED.get(data[at], chr(data[at])))
            at = octal.end() if octal else at + 1
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            break
        out.append(chr(c))
    return "".join(out), at


def _hexadecimal(lexeme: bytes) -> str:
    digits = bytes(c for c in lexeme if c in b"0123456789abcdefABCDEF")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")


def _shown(content: bytes) -> str:
    """The text a content stream shows: operands gather until an operator takes them all."""
    out: list[str] = []
    operands: list[str] = []
    at, in_array = 0, False
    while (m := _LEXEME.match(content, at)) is not None:
        lexeme, at = m[0], m.end()
        if lexeme == b"(":
            text, at = _literal(content, at)
            operands.append(text)
        elif lexeme[:1] == b"<" and lexeme != b"<<":
            operands.append(_hexadecimal(lexeme))
        elif lexeme in (b"[", b"]"):
            in_array = lexeme == b"["
        elif lexeme[:1].isspace() or lexeme[:1] in (b"%", b"/"):
            continue
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", lexeme):
            if in_array and float(lexeme) <= -GAP:
                operands.append(" ")
        elif not in_array:
            if lexeme in _SHOWS:
                out += ["\n" if lexeme in _OPENS_LINE else "", *operands, " "]
            elif lexeme == b"T*":
                out.append("\n")
            operands = []
    return "".join(out)


def _streams(data: bytes) -> Iterator[bytes]:
    """The bodies between ``stream`` and ``endstream``, inflated where they are deflated, with or without a header."""
    at = 0
    while (opened := re.compile(rb"stream\r?\n").search(data, at)) and (end := data.find(b"endstream", opened.end())) >= 0:
        body, at = data[opened.end() : end].removesuffix(b"\n").removesuffix(b"\r"), end + len(b"endstream")
        for header in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
            with contextlib.suppress(zlib.error):
                body = zlib.decompress(body, header)
                break
        yield body


def pdf_text(data: bytes) -> str:
    """The text that a PDF's content streams show; '' when there is none."""
    pages = [_shown(body) for body in _streams(data) if re.search(rb"\bT[jJ]\b|\)\s*'", body)]
    lines = [re.sub(r"[ \t]+", " ", line).strip(" ") for line in "\n".join(pages).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


pdf_text_udf = per_value("string", lambda b: pdf_text(bytes(b)))


def _first_good(order: tuple[str, ...], have: dict[str, Column], nothing: str) -> Column:
    """The first text of ``order`` that passes the quality gate; the reason of the last rung otherwise."""
    there = [r for r in order if r in have]
    good = [F.when(assess_text(have[r])["ok"], F.struct(have[r].alias("text"), F.lit(r).alias("extractor"), F.lit(None).cast("string").alias("reason"))) for r in there]
    why = assess_text(have[there[-1]], nothing)["reason"] if there else F.lit(nothing)
    return F.coalesce(*good, F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("extractor"), why.alias("reason")))


def pdf_ladder(native: Column, **rungs: Column) -> Column:
    """``STRUCT<text, extractor, reason>``: the first rung, in ladder order, whose text passes the quality gate."""
    have = {"native": native, **{k.replace("_", "-"): v for k, v in rungs.items()}}
    return _first_good(PDF_RUNGS, have, "no text layer (scanned or image-only PDF?)")


def doc_ladder(**rungs: Column) -> Column:
    """``pdf_ladder`` for office documents: texts of converters by rung; refused when none of them is readable."""
    return _first_good(DOC_RUNGS, rungs, NO_CONVERTER)


# -- office formats and the router --------------------------------------------------------------


def doc_format_for_url(c: Column | str) -> Column:
    """``STRUCT<extension, text_fallback>`` of an office document's address; null for others."""
    ext = F.lower(F.regexp_extract(_col(c), r"(?i)\.([a-z0-9]{2,5})(?:$|[?#])", 1))
    return F.when(ext.isin(*DOC_EXTENSIONS), F.struct(ext.alias("extension"), (ext == "csv").alias("text_fallback")))


def doc_format_for_content_type(c: Column | str) -> Column:
    kind = F.lower(F.trim(F.split_part(_col(c), F.lit(";"), F.lit(1))))
    return F.when(kind.isin(*DOC_CONTENT_TYPES), F.struct(kind.alias("content_type"), (kind == "text/csv").alias("text_fallback")))


def extract(responses: DataFrame) -> DataFrame:
    """Stored responses to text: ``responses(url, status, content_type, bytes)`` with ``text, title, note, extractor, canonical, meta_description`` appended.

    A router of column expressions: not modified, failed, PDF, office, HTML,
    plain. A failure is a row with a note. Office files other than CSV need an
    outside converter and are refused.
    """
    kind = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    body = F.coalesce(decoded("bytes", "content_type"), F.lit(""))
    with_body = responses.withColumn("_body", body)
    is_pdf = kind.contains("application/pdf") | looks_like_pdf("url") | (F.substring("bytes", F.lit(1), F.lit(5)) == F.lit(b"%PDF-"))
    office = F.coalesce(doc_format_for_url("url")["text_fallback"], doc_format_for_content_type("content_type")["text_fallback"])
    is_html = kind.contains("html") | F.lower(F.substring("_body", 1, 2000)).rlike(r"<!doctype html|<html")
    route = (
        F.when(F.col("status") == 304, "not-modified")
        .when((F.col("status") < 200) | (F.col("status") > 299), "failed")
        .when(is_pdf, "pdf")
        .when(office.isNotNull() & ~office, "office")
        .when(is_html, "html")
        .otherwise("plain")
    )
    routed = with_body.withColumn("_route", route)
    by = lambda name, value: F.when(F.col("_route") == name, value)
    page = by("html", F.col("_body"))
    readable = strings(lambda p: html_to_text(main_html(p)))
    pdf = pdf_text_udf(by("pdf", F.col("bytes")))
    text = F.coalesce(readable(page), by("plain", F.col("_body")), F.when(assess_text(pdf)["ok"], pdf), F.lit(""))
    told = routed.withColumn("text", text).withColumn("title", html_title_udf(page)).withColumn("canonical", canonical_link_udf(page)).withColumn("meta_description", meta_description_udf(page))
    note = (
        by("failed", F.concat(F.lit("status "), F.col("status")))
        .when(F.col("_route") == "not-modified", "not modified")
        .when(F.col("_route") == "office", NO_CONVERTER)
        .when((F.col("_route") == "pdf") & (F.col("text") == ""), assess_text(pdf)["reason"])
        .otherwise(junk_reason("text"))
    )
    names = {"pdf": "native-pdf", "html": "native", "plain": "plain"}
    extractor = F.coalesce(*[by(k, F.lit(v)) for k, v in names.items()])
    return told.withColumn("note", note).withColumn("extractor", F.when(F.col("text") != "", extractor)).drop("_body", "_route")

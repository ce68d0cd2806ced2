"""Reading reports: claim units, citation tokens, figures, masks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.batched import per_value
from textmill.functions.text import SPACE, _col, trim_space

# Bracketed tokens that are no links, and the shapes of their kinds.
TOKEN = r"\[([^\]\n]+)\](?!\()"
SOURCE_TOKEN = r"^S\d+$"
EVIDENCE_TOKEN = r"^E\d+$"
FILE_LINE_TOKEN = r"^(.+?):(\d+)(?:-(\d+))?$"


def strip_inline_code(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"`[^`\n]*`", " ")


def bracketed_tokens(c: Column | str) -> Column:
    """Distinct bracketed tokens outside inline code, in order."""
    raw = F.regexp_extract_all(strip_inline_code(F.coalesce(_col(c), F.lit(""))), F.lit(TOKEN), F.lit(1))
    return F.array_distinct(F.transform(raw, trim_space))


def citation_tokens(c: Column | str, pattern: str = SOURCE_TOKEN) -> Column:
    """The bracketed tokens that match ``pattern``."""
    return F.filter(bracketed_tokens(c), lambda t: t.rlike(pattern))


def file_line(c: Column | str) -> Column:
    """``STRUCT<path, start, end>`` of ``path:12`` or ``path:12-40``; null for other text and for backward or zero lines."""
    t = trim_space(c)
    start = F.regexp_extract(t, FILE_LINE_TOKEN, 2).try_cast("bigint")
    end = F.coalesce(F.nullif(F.regexp_extract(t, FILE_LINE_TOKEN, 3), F.lit("")).try_cast("bigint"), start)
    return F.when((start >= 1) & (end >= start), F.struct(F.regexp_extract(t, FILE_LINE_TOKEN, 1).alias("path"), start.alias("start"), end.alias("end")))


def normalize_numerals(c: Column | str) -> Column:
    """Digit groups joined, a decimal comma to a point."""
    s = F.regexp_replace(_col(c), r"(\d)[\x{a0}\x{202f}'](?=\d)", "$1")
    s = F.regexp_replace(s, r"(\d)[, ](\d{3})(?!\d)", "$1$2")
    return F.regexp_replace(s, r"(\d),(?=\d)", "$1.")


def numerals(c: Column | str, most: int = 8) -> Column:
    """Distinct figures of a text, normalised; digits of citations, code and link addresses aside, single digits aside."""
    s = strip_inline_code(F.coalesce(_col(c), F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, r"\[([^\]]+)\]\([^)]*\)", "$1"), r"\[[^\]\n]+\](?!\()", " ")
    found = F.regexp_extract_all(normalize_numerals(s), F.lit(r"\d[\d,\x{a0}\x{202f}']*(?:\.\d+)?%?"), F.lit(0))
    plain = F.transform(found, lambda m: F.regexp_replace(normalize_numerals(m), r"[,\x{a0}\x{202f}'%]", ""))
    worth = F.filter(plain, lambda n: (F.length(F.regexp_replace(n, r"\D", "")) >= 2) | n.contains("."))
    return F.slice(F.array_distinct(worth), 1, most)


# -- masks over the lines of a document ---------------------------------------------------------


def code_mask(lines: Column) -> Column:
    """True for lines of fenced code and its fences: those behind an odd number of fences, and every fence."""
    fence = lambda line: line.rlike(rf"^{SPACE}*(```|~~~)")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<boolean>").alias("mask"))

    def step(acc, line):
        inside = acc["inside"] != fence(line)
        return F.struct(inside.alias("inside"), F.concat(acc["mask"], F.array(fence(line) | acc["inside"])).alias("mask"))

    return F.aggregate(lines, start, step)["mask"]


def appendix_mask(lines: Column) -> Column:
    """True from a heading of sources, references or a bibliography to the next heading of its level or above."""
    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<boolean>").alias("mask"))

    def step(acc, line):
        depth = F.length(F.regexp_extract(line, rf"^{SPACE}*(#{{1,6}}){SPACE}", 1))
        left = F.when((acc["level"] > 0) & (depth > 0) & (depth <= acc["level"]), F.lit(0)).otherwise(acc["level"])
        opens = F.length(F.regexp_extract(line, rf"(?i)^{SPACE}*(#{{2,6}}){SPACE}+(sources|references|bibliography)\b", 1))
        level = F.when(left == 0, opens).otherwise(left)
        return F.struct(level.alias("level"), F.concat(acc["mask"], F.array(level > 0)).alias("mask"))

    return F.aggregate(lines, start, step)["mask"]


def quote_runs(lines: Column) -> Column:
    """For each line the number of the quote run it lies in, 0 outside of quotes."""
    start = F.struct(F.lit(0).alias("run"), F.lit(False).alias("was"), F.array().cast("array<int>").alias("runs"))

    def step(acc, line):
        quoted = line.rlike(rf"^{SPACE}*>")
        run = acc["run"] + F.when(quoted & ~acc["was"], F.lit(1)).otherwise(0)
        return F.struct(run.alias("run"), quoted.alias("was"), F.concat(acc["runs"], F.array(F.when(quoted, run).otherwise(0))).alias("runs"))

    return F.aggregate(lines, start, step)["runs"]


def marked_quote_mask(lines: Column, marker: str) -> Column:
    """``STRUCT<mask, regions>``: lines of quote runs in which some line matches ``marker``, and how many such runs."""
    runs = quote_runs(lines)
    hits = F.zip_with(lines, runs, lambda line, r: F.when(line.rlike(marker) & (r > 0), r))
    marked = F.array_distinct(F.filter(hits, lambda r: r.isNotNull()))
    return F.struct(F.transform(runs, lambda r: F.array_contains(marked, r)).alias("mask"), F.size(marked).alias("regions"))


def or_masks(*masks: Column) -> Column:
    out = masks[0]
    for m in masks[1:]:
        out = F.zip_with(out, m, lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    return out


# -- claim units --------------------------------------------------------------------------------

_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^#{1,6}\s")
_RULE = re.compile(r"^([-*_])\1{2,}$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+\.)\s+(?=\S)")
_QUOTE = re.compile(r"^\s*>\s?")


def _kind(line: str) -> str:
    """What a line is, inline code aside."""
    t = line.strip()
    if not t or _HEADING.match(t) or _RULE.match(t):
        return "heading" if _HEADING.match(t) else "gap"
    if "|" in line:
        return "gap" if "-" in line and re.fullmatch(r"[\s:|-]+", t) else "row"
    return "quote" if re.match(r"^\s*>", line) else "item" if _ITEM.match(line) else "prose"


def claim_units(
    text: str,
    exclude: Sequence[bool] | None = None,
    quotes: str = "unit",
    skip_table_header: bool = True,
    keep_inline_code: bool = False,
    section_tag: Callable[[str], str | None] | None = None,
) -> list[dict]:
    """A report's claims: paragraphs, table rows, quotes as text; lists as items. Code, comments and headings are none.

    Lines are classified first; runs of one class then form the units. Lines
    marked in ``exclude`` count as code; a mask shorter than the text excludes
    nothing beyond its end. ``section_tag`` maps a heading to the ``section`` of
    the units up to the next heading, or to None.
    """
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    lines = re.sub(r"<!--[\s\S]*?-->", blank, text).split("\n")
    bare = [re.sub(r"`[^`\n]*`", " ", line) for line in lines]
    shown = lines if keep_inline_code else bare
    kinds, fenced = [], False
    for raw, line in zip(lines, bare):
        fence = bool(_FENCE.match(raw))
        kinds.append("code" if fence or fenced else _kind(line))
        fenced = fenced != fence
    for i, out in enumerate(() if exclude is None else exclude):
        if out and i < len(kinds):
            kinds[i] = "code"
    if quotes == "prose":
        kinds = ["prose-quote" if k == "quote" else k for k in kinds]
    units: list[dict] = []
    run: list[str] = []
    mode, section = "", None

    def said_so(kind: str, text: str | None, items: list[str]) -> None:
        units.append({"kind": kind, "text": text, "items": items} | ({} if section is None else {"section": section}))

    def close() -> None:
        nonlocal run, mode
        if mode == "list":
            said_so("list", None, run)
        elif run:
            said_so("text", " ".join(run), [])
        run, mode = [], ""

    separator = [k == "gap" and "|" in b for k, b in zip(kinds, bare)] + [False]
    for i, (kind, line) in enumerate(zip(kinds, shown)):
        if mode == "list" and kind in ("prose", "quote", "prose-quote"):
            run[-1] += f" {line.strip()}"
        elif kind == "item":
            if mode != "list":
                close()
                mode = "list"
            run.append(_ITEM.sub("", line).strip())
        elif kind in ("gap", "heading", "code"):
            close()
            if kind == "heading" and section_tag:
                section = section_tag(bare[i].strip())
        elif kind == "row":
            close()
            if not (skip_table_header and separator[i + 1]):
                cells = re.sub(r"\|$", "", re.sub(r"^\|", "", line.strip())).split("|")
                said_so("text", " ".join(c.strip() for c in cells), [])
        else:
            now = "quote" if kind == "quote" else "prose"
            if mode != now:
                close()
                mode = now
            said = _QUOTE.sub("", line).strip() if "quote" in kind else line
            if said or kind == "prose":
                run.append(said)
    close()
    return units


_UNITS = "array<struct<kind:string,text:string,items:array<string>,section:string>>"


def claim_units_column(text: Column | str, exclude: Column | None = None, **options) -> Column:
    """``claim_units`` of a column; ``exclude`` is a mask over its lines, such as ``appendix_mask`` or several through ``or_masks``."""
    f = per_value(_UNITS, lambda t, mask=None: claim_units(t, mask, **options))
    return f(text) if exclude is None else f(text, exclude)


def unit_texts(unit: Column) -> Column:
    return F.when(unit["kind"] == "text", F.array(unit["text"])).otherwise(unit["items"])


def collect_citations(text: Column | str, pattern: str = SOURCE_TOKEN, exclude: Column | None = None) -> Column:
    """``STRUCT<grounding, inert_only>``: tokens inside claims, and tokens that occur nowhere but outside of them."""
    units = claim_units_column(text, exclude)
    grounding = F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(units, unit_texts)), lambda t: citation_tokens(t, pattern))))
    every = F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN), F.lit(1)), trim_space)
    every = F.array_distinct(F.filter(every, lambda t: t.rlike(pattern)))
    return F.struct(grounding.alias("grounding"), F.array_except(every, grounding).alias("inert_only"))


def dangling_tokens(cited: DataFrame, known: DataFrame, token: str = "token") -> DataFrame:
    """Distinct cited tokens that nothing known bears; nulls are no tokens."""
    return cited.select(token).where(F.col(token).isNotNull()).distinct().join(known.select(token), token, "left_anti")


def uncited_ids(cited: DataFrame, known: DataFrame, token: str = "token") -> DataFrame:
    """Distinct known identifiers that no claim cites: the difference the other way round."""
    return dangling_tokens(known, cited, token)

"""Nested facts out of one document: tables, embedded JSON, metadata, feeds, sitemaps, robots rules, links."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import takewhile
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.batched import per_record, per_value
from textmill.functions.elements import Mark, Node, closed, marks, next_mark, tags, tree
from textmill.functions.markup import decode_entities
from textmill.functions.text import _col
from textmill.functions.urls import canonical_url, query_of, path_of, resolved_url

_I = re.I


def structs(kind: str) -> Callable:
    """Decorator: keeps the function plain and adds ``.column``, the same over columns in Arrow batches."""

    def wrap(f: Callable) -> Callable:
        f.column = per_value(kind, f)
        return f

    return wrap


# -- tables -------------------------------------------------------------------------------------

# The references a cell may hold by name; the ampersand's own comes after all others.
_CELL_REFS = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_NUMBER_REF = re.compile(r"&#(?:x(?P<hex>[0-9a-f]+)|(?P<dec>[0-9]+));", _I)
_NAME_REF = re.compile("&(" + "|".join(_CELL_REFS) + ");", _I)
_AMP_REF = re.compile("&amp;", _I)
MOST_SPANNED = 100


def _numbered(m: re.Match) -> str:
    return chr(min(int(m["hex"], 16) if m["hex"] else int(m["dec"]), 0x10FFFF))


def cell_text(markup: str) -> str:
    """Visible text of a cell: breaks are blanks, other tags nothing. Numeric references are read first, ``&amp;`` last."""
    pieces, at = [], 0
    for mark in marks(markup):
        pieces += [markup[at : mark.start], " " if mark.name == "br" and not mark.closing else ""]
        at = mark.end
    visible = " ".join("".join([*pieces, markup[at:]]).split())
    named = _NAME_REF.sub(lambda m: _CELL_REFS[m[1].lower()], _NUMBER_REF.sub(_numbered, visible))
    return _AMP_REF.sub("&", named).strip()


def _spanned(cell: Mark, name: str) -> int:
    """How many columns or rows a cell claims: 1 without a number, within bounds with one."""
    digits = "".join(takewhile(str.isdecimal, cell.attributes.get(name, "").strip()))
    return min(max(int(digits), 1), MOST_SPANNED) if digits else 1


def _tables_of(page: str) -> Iterator[tuple[str | None, list[list[tuple[str, str, int, int]]]]]:
    """``(caption, rows of (kind, text, columns, rows))`` of every closed table, in one walk over the marks.

    A row or cell counts once it is closed; a table ends at the first closing
    tag of its kind, so the cells of a table inside a cell are no cells.
    """
    table = row = cell = caption = None
    rows: list = []
    said: str | None = None
    for mark in marks(page):
        if mark.name == "table":
            if mark.closing and table:
                yield said, rows
                table = None
            elif not mark.closing and not table:
                table, row, cell, caption, rows, said = mark, None, None, None, [], None
        elif not table:
            continue
        elif mark.name == "caption" and said is None:
            if not mark.closing:
                caption = caption or mark
            elif caption:
                said = cell_text(page[caption.end : mark.start])
        elif mark.name == "tr":
            if not mark.closing and row is None:
                row, cell = [], None
            elif mark.closing and row is not None:
                rows += [row] if row else []
                row = None
        elif mark.name in ("td", "th") and row is not None:
            if not mark.closing:
                cell = cell or mark
            elif cell and cell.name == mark.name:
                row.append((cell.name, cell_text(page[cell.end : mark.start]), _spanned(cell, "colspan"), _spanned(cell, "rowspan")))
                cell = None


def laid_out(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells ``(text, columns, rows)`` copied into every place they span; rows padded to the widest."""
    below: dict[tuple[int, int], str] = {}
    grid: list[dict[int, str]] = []
    for r, cells in enumerate(rows):
        line = {c: t for (rr, c), t in below.items() if rr == r}
        claimed = set(line)
        c = 0
        for text, wide, tall in cells:
            while c in claimed:
                c += 1
            for k in range(c, c + wide):
                line[k] = text
                below.update({(r + d, k): text for d in range(1, tall)})
            c += wide
        # a claimed place beyond the row's last cell counts only if nothing before it is free
        last = c
        while last in claimed:
            last += 1
        grid.append({k: t for k, t in line.items() if k < last})
    width = max((max(line, default=-1) + 1 for line in grid), default=0)
    return [[line.get(k, "") for k in range(width)] for line in grid]


_TABLE = "array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>"


@structs(_TABLE)
def extract_tables(page: str) -> list[dict]:
    """Every table with data rows; the first row is its header if all its cells are header cells."""
    out = []
    for caption, rows in _tables_of(page):
        if not rows:
            continue
        grid = laid_out([[cell[1:] for cell in row] for row in rows])
        head = 1 if {cell[0] for cell in rows[0]} == {"th"} else 0
        if grid[head:]:
            out.append({"caption": caption, "headers": grid[0] if head else [], "rows": grid[head:]})
    return out


def table_to_markdown(table: Column) -> Column:
    """A table struct as markdown, pipes in cells escaped."""
    rows, headers = table["rows"], table["headers"]
    width = F.greatest(F.lit(1), F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    places = F.sequence(F.lit(0), width - 1)

    def line(cells: Column) -> Column:
        texts = F.transform(places, lambda i: F.replace(F.coalesce(F.get(cells, i), F.lit("")), F.lit("|"), F.lit("\\|")))
        return F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))

    caption = F.when(table["caption"].isNotNull() & (table["caption"] != ""), F.array(F.concat(F.lit("**"), table["caption"], F.lit("**")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(places, lambda _: F.lit(" --- |")), ""))
    return F.array_join(F.concat(caption, F.array(line(headers), rule), F.transform(rows, line)), "\n")


# -- embedded JSON and meta tags ----------------------------------------------------------------


def _scripts(page: str, kind: str) -> Iterator[str]:
    """What closed script elements of a media type hold; marks inside a script are none."""
    at = 0
    while (mark := next_mark(page, at)) is not None:
        at = mark.end
        if mark.name == "script" and not mark.closing and (end := closed(page, mark)):
            at = end.end()
            if mark.attributes.get("type", "").lower() == kind:
                yield page[mark.end : end.start()]


def json_ld(page: str) -> list:
    """Objects of all ``ld+json`` blocks that parse, lists and ``@graph`` flattened."""
    out: list = []
    for block in _scripts(page, "application/ld+json"):
        try:
            value = json.loads(block.strip().removeprefix("<!--").removesuffix("-->"))
        except ValueError:
            continue
        inner = value.get("@graph") if isinstance(value, dict) else None
        out += inner if isinstance(inner, list) else value if isinstance(value, list) else [value]
    return out


@structs("array<string>")
def json_ld_texts(page: str) -> list[str]:
    return [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in json_ld(page)]


@structs("map<string,string>")
def meta_tags(page: str) -> dict[str, str]:
    """Property, name or itemprop (the first that is not empty) in lower case to content; the first of a name wins."""
    out: dict[str, str] = {}
    for attributes in tags(page, "meta"):
        said = {a: decode_entities(v).strip() for a, v in attributes.items()}
        key = said.get("property") or said.get("name") or said.get("itemprop")
        if key and said.get("content"):
            out.setdefault(key.lower(), said["content"])
    return out


def _names(value) -> list[str]:
    """All non-blank strings of a JSON value, in order; of objects their name."""
    found, ahead = [], [value]
    while ahead:
        v = ahead.pop()
        if isinstance(v, str):
            found += filter(None, [v.strip()])
        elif isinstance(v, list):
            ahead += reversed(v)
        elif isinstance(v, dict):
            ahead.append(v.get("name"))
    return found


# Where each fact is looked up, embedded JSON before meta tags.
_LD_FIELDS = {
    "type": ("@type",),
    "title": ("headline", "name"),
    "description": ("description",),
    "published_at": ("datePublished",),
    "modified_at": ("dateModified",),
    "canonical_url": ("url", "@id"),
    "image_url": ("image",),
    "site_name": ("publisher",),
}
_META_FIELDS = {
    "title": ("og:title", "twitter:title"),
    "description": ("og:description", "description", "twitter:description"),
    "type": ("og:type",),
    "site_name": ("og:site_name",),
    "published_at": ("article:published_time", "datepublished", "citation_publication_date"),
    "modified_at": ("article:modified_time", "datemodified"),
    "image_url": ("og:image", "twitter:image"),
    "canonical_url": ("og:url",),
}
_META_AUTHORS = ("article:author", "author", "citation_author", "dc.creator")
_META = "struct<type:string,title:string,description:string,published_at:string,modified_at:string,canonical_url:string,image_url:string,site_name:string,authors:array<string>,json_ld:array<string>>"


def page_metadata(page: str) -> dict:
    """What a page says about itself; embedded JSON wins over meta tags, and those over the title element."""
    nodes, meta = json_ld(page), meta_tags(page)
    objects = [n for n in nodes if isinstance(n, dict)]
    out: dict = {}
    for fact in _LD_FIELDS:
        said = [s for n in objects for k in _LD_FIELDS[fact] for s in _names(n.get(k))[:1]]
        tagged = [meta[k] for k in _META_FIELDS[fact] if k in meta]
        out[fact] = (said or tagged or [None])[0]
    authors = [a for n in objects for a in _names(n.get("author"))] + [meta[k] for k in _META_AUTHORS if k in meta]
    if out["title"] is None and (m := re.search(r"<title[^>]*>([\s\S]*?)</title>", page, _I)):
        out["title"] = re.sub(r"\s+", " ", decode_entities(m[1])).strip() or None
    return out | {"authors": list(dict.fromkeys(authors)), "json_ld": [json.dumps(n, ensure_ascii=False, separators=(",", ":")) for n in nodes]}


page_metadata_udf = per_record(_META, [*_LD_FIELDS, "authors", "json_ld"], page_metadata)


# -- feeds and sitemaps -------------------------------------------------------------------------


_NO_PAGE = frozenset("self edit replies enclosure".split())


def _plain(text: str) -> str:
    """One line without markup: what raw text still holds of it is taken out, then references decoded."""
    return " ".join(decode_entities(re.sub(r"<[^>]+>", " ", text)).split())


def _first(node: Node, *names: str, but: frozenset[str] = frozenset()) -> str | None:
    """The text of the first element of each name in turn, until one has any."""
    for name in names:
        found = next((n for n in node.walk(but) if n.name == name), None)
        if found and (text := _plain(found.text())):
            return text
    return None


def _address(entry: Node) -> str | None:
    """An entry's page: a link's ``href``, preferably none that points elsewhere than to it; else the link or identifier as text."""
    links = [n.attributes for n in entry.walk() if n.name == "link" and n.attributes.get("href")]
    links.sort(key=lambda a: a.get("rel", "").lower() in _NO_PAGE)  # stable: document order otherwise
    return decode_entities(links[0]["href"]).strip() if links else _first(entry, "link", "guid")


_FEED = "struct<kind:string,title:string,items:array<struct<title:string,url:string,published:string,summary:string,id:string>>>"
#: Where each fact of an entry stands in either format, in order of preference.
_ENTRY = {"title": ("title",), "published": ("pubdate", "published", "updated", "dc:date"), "summary": ("description", "summary"), "id": ("guid", "id")}


def parse_feed(xml: str) -> dict | None:
    """RSS or Atom; null for what is neither. Items without title and address are left out."""
    root = tree(xml)
    named = {n.name: n for n in reversed(list(root.walk()))}
    if not named.keys() & {"rss", "channel", "entry"} and "www.w3.org/2005/Atom" not in getattr(named.get("feed"), "attributes", {}).get("xmlns", ""):
        return None
    kind, unit = ("rss", "item") if named.keys() & {"rss", "channel"} else ("atom", "entry")
    entries = [n for n in root.walk() if n.name == unit]
    items = [{"url": _address(e), **{fact: _first(e, *names) for fact, names in _ENTRY.items()}} for e in entries]
    return {"kind": kind, "title": _first(root, "title", but=frozenset([unit])), "items": [i for i in items if i["title"] or i["url"]]}


parse_feed_udf = per_record(_FEED, ["kind", "title", "items"], lambda xml: parse_feed(xml) if xml else None)
_FEED_TYPES = frozenset(("application/rss+xml", "application/atom+xml", "application/feed+json"))


@structs("array<string>")
def discover_feeds(page: str, base: str) -> list[str]:
    """Addresses of the feeds a page announces, resolved against its own."""
    offered = [a["href"] for a in tags(page, "link") if a.get("href") and a.get("type", "").lower() in _FEED_TYPES and "alternate" in a.get("rel", "").lower().split()]
    return list(dict.fromkeys(resolved_url(decode_entities(h).strip(), base) or urljoin(base, h) for h in offered))


_SITEMAP = "struct<urls:array<struct<loc:string,lastmod:string>>,sitemaps:array<string>>"


def parse_sitemap(xml: str) -> dict:
    """Page entries, and the addresses of further sitemaps."""
    nodes = list(tree(xml).walk())
    index = any(n.name == "sitemapindex" for n in nodes)
    told = [(n.name == "sitemap" or index, _first(n, "loc"), n) for n in nodes if n.name in ("sitemap", "url")]
    pages = [{"loc": loc, "lastmod": _first(n, "lastmod")} for further, loc, n in told if loc and not further]
    return {"urls": pages, "sitemaps": [loc for further, loc, _ in told if loc and further]}


parse_sitemap_udf = per_record(_SITEMAP, ["urls", "sitemaps"], lambda xml: parse_sitemap(xml or ""))


# -- robots rules -------------------------------------------------------------------------------

_ROBOTS = "struct<rules:array<struct<allow:boolean,path:string>>,crawl_delay_ms:bigint,sitemaps:array<string>,absent:boolean>"


def parse_robots(body: str | None, agent: str) -> dict:
    """The rules of the group that names the agent most closely, longest path first, Allow before Disallow on ties."""
    if not body or not body.strip():
        return {"rules": [], "crawl_delay_ms": None, "sitemaps": [], "absent": True}
    groups: dict[str, list[tuple[str, str]]] = {}
    sitemaps: list[str] = []
    named: list[str] = []
    heading = False
    for raw in re.split(r"\r?\n", body):
        name, colon, value = re.sub(r"#.*$", "", raw).strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "sitemap":
            sitemaps += [value] * bool(value)
        elif name == "user-agent":
            named = [*(named if heading else []), value.lower()]
            heading = True
            groups.setdefault(value.lower(), [])
        else:
            heading = False
            for g in named:
                groups[g].append((name, value))
    fits = [g for g in groups if g != "*" and g in agent.lower()]
    chosen = groups.get(max(fits, key=len) if fits else "*", [])
    rules = sorted(({"allow": n == "allow", "path": v} for n, v in chosen if n in ("allow", "disallow")), key=lambda r: (-len(r["path"]), not r["allow"]))
    delays = [float(v) for n, v in chosen if n == "crawl-delay" and re.fullmatch(r"\d+(\.\d*)?|\.\d+", v)]
    return {"rules": rules, "crawl_delay_ms": round(delays[-1] * 1000) if delays else None, "sitemaps": sitemaps, "absent": False}


parse_robots_udf = per_record(_ROBOTS, ["rules", "crawl_delay_ms", "sitemaps", "absent"], lambda body, agent: parse_robots(body, agent or ""))


def is_allowed(robots: Column | str, url: Column | str) -> Column:
    """The first rule, longest first, that matches path and query decides; without one, or for no URL, yes."""
    r = _col(robots)
    path = F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/"))
    path = F.when(query_of(url) != "", F.concat(path, F.lit("?"), query_of(url))).otherwise(path)

    def matches(rule: Column) -> Column:
        p = rule["path"]
        quoted = F.regexp_replace(p, r"([.+?^{}()|\[\]\\])", r"\\$1")
        body = F.regexp_replace(F.regexp_replace(quoted, r"\$$", ""), r"\$", r"\\\$")
        pattern = F.concat(F.lit("(?s)^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(p.endswith("$"), F.lit(r"\z")).otherwise(F.lit("")))
        return (p != "") & F.regexp_like(path, pattern)

    first = F.get(F.filter(r["rules"], matches), F.lit(0))
    whole = F.call_function("try_parse_url", _col(url), F.lit("HOST")).isNotNull()
    return F.when(r["absent"] | ~whole, F.lit(True)).otherwise(F.coalesce(first["allow"], F.lit(True)))


# -- links --------------------------------------------------------------------------------------


#: Schemes of addresses that are no pages.
NO_PAGE = {"mailto", "tel", "javascript", "data"}


@structs("array<string>")
def links_from(page: str, base: str) -> list[str]:
    """Absolute web addresses a page links to, the first of each canonical form; one with a fragment is no link."""
    given = (a.get("href", "").strip() for a in tags(page, "a"))
    pages = (h for h in given if h and "#" not in h and h.partition(":")[0].lower() not in NO_PAGE)
    found: dict[str, str] = {}
    for absolute in filter(None, (resolved_url(h, base) for h in pages)):
        found.setdefault(canonical_url(absolute), absolute)
    return list(found.values())

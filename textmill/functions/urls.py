"""URL identity and URL predicates.

Predicates and parts are Column expressions. Canonical form and resolution
against a base follow the web's URL rules and run as Arrow-batched UDFs.
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import parse_qsl, quote, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.batched import per_value
from textmill.functions.lexicon import API_HOSTS, ID_PARAMS
from textmill.functions.text import _col

# Fixed value: query parameters that say where a visitor came from, not what the page is.
TRACKING = re.compile(r"^(utm_|fbclid$|gclid$|mc_|ref$|ref_src$|ref_url$|spm$|_hsenc$|_hsmi$|igshid$)", re.I)
_DEFAULT_PORT = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_WEB = ("http", "https", "ftp", "ws", "wss", "file")
_SAFE = "~*!'()"
#: Addresses whose canonical form a worker remembers.
REMEMBERED_URLS = 20_000


def parsed_url(raw: str):
    """Split an absolute URL; ``ValueError`` for what is none."""
    raw = raw.strip()
    parts = urlsplit(raw)
    if not parts.scheme or not re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", raw):
        raise ValueError("no scheme")
    if parts.scheme in _WEB and parts.scheme != "file":
        if not parts.hostname or re.search(r"[\s<>^|%#]", parts.hostname):
            raise ValueError("no host")
        _ = parts.port
    return parts


@lru_cache(REMEMBERED_URLS)
def canonical_url(raw: str | None) -> str | None:
    """One spelling per resource: scheme and host lower-cased, no ``www.``, fragment, default port, tracking parameter or closing slash, other parameters sorted by name."""
    if raw is None:
        return None
    try:
        u = parsed_url(raw)
        host = re.sub(r"^www\.", "", (u.hostname or "").lower())
        port = "" if u.port in (None, _DEFAULT_PORT.get(u.scheme)) else f":{u.port}"
        path = u.path
        if u.scheme in _WEB:
            path = quote(_dots_removed(path or "/"), safe="/%:@!$&'()*+,;=-._~|[]^")
        kept = sorted(((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not TRACKING.match(k)), key=lambda kv: kv[0])
        query = "?" + "&".join(f"{quote(k, safe=_SAFE)}={quote(v, safe=_SAFE)}" for k, v in kept) if kept else ""
        return re.sub("/$", "", f"{u.scheme.lower()}://{host}{port}{path.rstrip('/')}{query}")
    except ValueError:
        return re.sub("/$", "", re.sub("#.*$", "", raw.strip(), flags=re.S))


def _dots_removed(path: str) -> str:
    if "/." not in path:
        return path
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p.lower() in (".", "%2e"):
            if last:
                out.append("")
        elif p.lower() in ("..", ".%2e", "%2e.", "%2e%2e"):
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def resolved_url(href: str, base: str) -> str | None:
    """``href`` against ``base`` without its fragment; null unless it is a web page's address."""
    try:
        joined = urljoin(base, href.strip())
        u = parsed_url(joined)
        if u.scheme.lower() not in ("http", "https"):
            return None
        host = u.hostname.lower()
        port = "" if u.port in (None, _DEFAULT_PORT.get(u.scheme)) else f":{u.port}"
        query = f"?{u.query}" if u.query else ""
        return f"{u.scheme.lower()}://{host}{port}{quote(_dots_removed(u.path or '/'), safe=chr(37) + '/:@!$&()*+,;=-._~|[]^' + chr(39))}{query}"
    except ValueError:
        return None


_canonical_udf = per_value("string", canonical_url)


def canonicalize_url(c: Column | str) -> Column:
    """Arrow-batched ``canonical_url``; a worker parses an address once while it remembers it."""
    return _canonical_udf(c)


def _part(c: Column | str, part: str) -> Column:
    return F.call_function("try_parse_url", F.trim(_col(c)), F.lit(part))


def host_of(c: Column | str) -> Column:
    return F.lower(_part(c, "HOST"))


def path_of(c: Column | str) -> Column:
    return F.coalesce(_part(c, "PATH"), F.lit(""))


def query_of(c: Column | str) -> Column:
    return F.coalesce(_part(c, "QUERY"), F.lit(""))


def scheme_of(c: Column | str) -> Column:
    return F.lower(_part(c, "PROTOCOL"))


def bare_host(c: Column | str) -> Column:
    return F.regexp_replace(host_of(c), r"^www\.", "")


def domain_of(c: Column | str) -> Column:
    """The bare host, ``local file`` for file addresses, '' for what is no URL."""
    return F.when(scheme_of(c) == "file", F.lit("local file")).otherwise(F.coalesce(bare_host(c), F.lit("")))


def normalize_doi(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(c))), r"^https?://(dx\.)?doi\.org/", "")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def arxiv_id(c: Column | str) -> Column:
    """The arXiv identifier an address names, without version; null if none."""
    path = path_of(c)
    modern = _found(path, r"(?i)/(?:abs|pdf|html|format)/(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$")
    legacy = _found(path, r"(?i)/(?:abs|pdf|html|format)/([a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?$")
    return F.when(host_of(c).rlike(r"(^|\.)arxiv\.org$"), F.lower(F.coalesce(modern, legacy)))


def doi_of(c: Column | str) -> Column:
    """The DOI an address carries, normalised; null if none."""
    path = path_of(c)
    whole = normalize_doi(F.try_url_decode(F.regexp_replace(path, "^/+|/+$", "")))
    inside = _found(path, r"(?i)/doi(?:/(?:abs|full|pdf|epdf|e?pub))?/(10\.\d{4,9}/[^\s?#]+)")
    inside = normalize_doi(F.regexp_replace(F.try_url_decode(inside), "/+$", ""))
    return F.when(host_of(c).rlike(r"(^|\.)(dx\.)?doi\.org$"), F.when(whole.rlike(r"^10\.\d{4,9}/"), whole)).otherwise(inside)


def is_api_endpoint(c: Column | str) -> Column:
    """Whether an address serves a machine payload."""
    api_path = path_of(c).rlike(r"(?i)^/europepmc/webservices/|^/search/publ/api|^/api/|\.(fcgi|cgi)$")
    payload = F.concat(F.lit("?"), query_of(c)).rlike(r"(?i)[?&](format|retmode|rettype|output)=(json|xml|text|atom|csv|bibtex)\b")
    return F.coalesce(bare_host(c).isin(*API_HOSTS), F.lit(False)) | (host_of(c).isNotNull() & (api_path | payload))


def is_citable_url(c: Column | str) -> Column:
    """A page a reader can open: http(s) and no API endpoint."""
    return F.coalesce(scheme_of(c).isin("http", "https") & host_of(c).isNotNull(), F.lit(False)) & ~is_api_endpoint(c)


_DOI = r"\b(10\.\d{4,9}/[^\s\"'<>()\[\],;]+)"


def url_declares_identity(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(_DOI) | _col(c).rlike(r"/(\d{4}\.\d{4,5}(?:v\d+)?)(?:$|[/?#])"), F.lit(False))


def addressed_id_count(c: Column | str) -> Column:
    """How many documents an address lists in an identifier parameter; 0 when it does not say."""

    def listed(name: str) -> Column:
        raw = F.try_url_decode(F.call_function("try_parse_url", F.trim(_col(c)), F.lit("QUERY"), F.lit(name)))
        n = F.size(F.filter(F.split(raw, r"[,\s+]+"), lambda s: F.trim(s) != ""))
        return F.when(raw.isNotNull() & (n > 0), n)

    return F.coalesce(*[listed(p) for p in ID_PARAMS], F.lit(0))


def citable_url(text: Column | str, canonical: Column | str) -> Column:
    """Where a payload can be read: its own canonical address, else its DOI, arXiv or PubMed identifier, from the first 4000 characters."""
    head = F.substring(_col(text), 1, 4000)
    doi = F.regexp_replace(_found(head, _DOI), r"[.,;:)\]]+$", "")
    arxiv = _found(head, r"(?i)\barxiv[:\s/]+((?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?)")
    pmid = _found(head, r"(?i)\bPMID:?\s*(\d{4,9})\b")
    return F.coalesce(
        F.when(is_citable_url(canonical), _col(canonical)),
        F.concat(F.lit("https://doi.org/"), doi),
        F.concat(F.lit("https://arxiv.org/abs/"), arxiv),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")),
    )


def looks_like_pdf(c: Column | str) -> Column:
    """A ``.pdf`` address, or a ``/pdf/<id>`` route whose end names no other format."""
    u = _col(c)
    route = u.rlike(r"(?i)/pdf/[^/?#]+($|[?#])") & ~u.rlike(r"(?i)\.(html?|php|aspx?|jsp|json|xml|txt|md|csv)($|[?#])")
    return F.coalesce(u.rlike(r"(?i)\.pdf($|[?#])") | route, F.lit(False))


def external_hosts(url: Column | str, text: Column | str) -> Column:
    """Distinct hosts that a text links to, its own and ``www.`` aside."""
    links = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(?i)https?://[a-z0-9.-]+"), F.lit(0))
    hosts = F.transform(links, lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"(?i)^https?://", "")), r"^www\.", ""))
    return F.array_except(F.array_distinct(F.filter(hosts, lambda h: h != "")), F.array(domain_of(url)))

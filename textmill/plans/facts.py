"""More registered queries: reports, pages and answers built from rows of a table, read back, each arm by the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import citations, hashing, markup, structure, text, urls
from textmill.operators import asof, state
from textmill.operators.cuts import work_path, written
from textmill.plans.catalog import query, table
from textmill.sources import apis, bytes as raw, responses, site, store


def said(*parts: Column | str) -> Column:
    """Strings and columns put together; a column is cast to a string."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def flags(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.when(m, "1").otherwise("0")), "")


# -- reports ------------------------------------------------------------------------------------


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 5 = s_suppkey THEN 'S' || s_suppkey ELSE 'S' || s_suppkey || ',S' || (s_suppkey % 5) END AS grounding,
           'S' || (s_suppkey + 1000) AS inert FROM supplier
""")
def collected_citations(spark, d):
    """A token in a paragraph and one in a list item ground; one in a fence, a comment or inline code, by the key, does not."""
    k = F.col("s_suppkey")
    other = said("[S", k + 1000, "]")
    hidden = F.when(k % 4 == 0, said("```\n", other, "\n```")).when(k % 4 == 1, said("~~~ py\n", other, "\n~~~")).when(k % 4 == 2, said("<!-- a\n", other, " -->")).otherwise(said("`see ", other, "`"))
    report = said("# Report [S", k + 1000, "]\n\nClaim [S", k, "] and [text](S9).\n\n", hidden, "\n\n- item [ S", k % 5, " ]\n")
    c = table(spark, d, "supplier").select("s_suppkey", citations.collect_citations(report).alias("c"))
    return c.select("s_suppkey", F.array_join("c.grounding", ",").alias("grounding"), F.array_join("c.inert_only", ",").alias("inert"))


@query("""
    SELECT s_suppkey, '0' || repeat('1', n + 2) || '0' || repeat('0', 6) AS code, '0' || repeat('0', n + 2) || '0' || '1110' || '00' AS appendix,
           '0' || repeat('0', n + 2) || '0' || '0000' || CASE WHEN n % 2 = 0 THEN '10' ELSE '00' END AS quotes, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS regions,
           CASE WHEN n % 2 = 0 THEN 'intro [S1]|after|end' ELSE 'intro [S1]|after|note said|end' END AS units
    FROM (SELECT s_suppkey, s_suppkey % 7 AS n FROM supplier)
""")
def line_masks(spark, d):
    """Masks over a report with a fence of 0 to 6 lines, a sources section and a quote that is marked or not; claims outside of all three."""
    n = F.col("s_suppkey") % 7
    fence = F.array_join(F.concat(F.array(F.lit("```")), F.array_repeat(F.lit("x = [S2]"), n.cast("int")), F.array(F.lit("```"))), "\n")
    quote = F.when(n % 2 == 0, F.lit("> NOTE said")).otherwise(F.lit("> note said"))
    report = said("intro [S1]\n", fence, "\nafter\n## Sources\n- one\n### Further\n# Next\n", quote, "\nend")
    docs = table(spark, d, "supplier").select("s_suppkey", report.alias("r"), F.split(report, "\n").alias("l"))
    masked = docs.select("s_suppkey", "r", citations.code_mask(F.col("l")).alias("c"), citations.appendix_mask(F.col("l")).alias("a"), citations.marked_quote_mask(F.col("l"), "NOTE").alias("q"))
    units = citations.claim_units_column("r", citations.or_masks(F.col("a"), F.col("q.mask")))
    told = F.array_join(F.flatten(F.transform(units, citations.unit_texts)), "|")
    return masked.select("s_suppkey", flags(F.col("c")).alias("code"), flags(F.col("a")).alias("appendix"), flags(F.col("q.mask")).alias("quotes"), F.col("q.regions").alias("regions"), told.alias("units"))


@query("""
    SELECT o_orderkey, unnest(list_transform(list_filter([
        {'no': 1, 'kind': 'text', 'said': 'Order ' || o_orderkey || ' went.'}, {'no': 2, 'kind': 'list', 'said': 'status ' || o_orderstatus || '|' || 'paid more'},
        {'no': 3, 'kind': 'text', 'said': 'h1 h2'}, {'no': 4, 'kind': 'text', 'said': o_orderpriority || ' ' || o_custkey}, {'no': 5, 'kind': 'text', 'said': 'quoted twice'}],
        lambda u: u.no <> 3 OR o_orderkey % 3 = 0), lambda u: u.kind || ':' || u.said)) AS unit FROM orders
""")
def claim_unit_round_trip(spark, d):
    """Paragraph, list with a continued item, table row and quote of a report; every third table has no separator, so its head is a row."""
    o = F.col
    separator = F.when(o("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.lit("|---|---|\n"))
    report = said("# Title\nOrder ", o("o_orderkey"), "\nwent.\n***\n* status ", o("o_orderstatus"), "\n1. paid\n   more\n\n| h1 | h2 |\n", separator, "| ", o("o_orderpriority"), " | ", o("o_custkey"), " |\n\n> quoted\n>twice\n")
    u = table(spark, d, "orders").select("o_orderkey", F.explode(citations.claim_units_column(report)).alias("u"))
    shown = said(F.col("u.kind"), ":", F.array_join(citations.unit_texts(F.col("u")), "|"))
    return u.select("o_orderkey", shown.alias("unit"))


@query("SELECT 'S' || (l_suppkey % 40) AS token, l_orderkey FROM lineitem WHERE l_suppkey % 40 >= 30 GROUP BY ALL")
def dangling_by_report(spark, d):
    """Cited tokens of each order's report that its sources lack: the difference within a row keeps the order of the text."""
    li = table(spark, d, "lineitem").select("l_orderkey", said("S", F.col("l_suppkey") % 40).alias("t"))
    reports = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(said("[", F.col("t"), "]")), " and ").alias("report"))
    known = F.array(*[F.lit(f"S{i}") for i in range(30)])
    return reports.select("l_orderkey", F.explode(F.array_except(citations.citation_tokens("report"), known)).alias("token"))


# -- pages and addresses ------------------------------------------------------------------------


@query("""
    SELECT s_suppkey, array_to_string(list_filter(['https://x.org/s/' || s_suppkey || '.xml', CASE WHEN s_suppkey % 2 = 0 THEN 'https://x.org/blog/atom?a=1&b=2' END, CASE WHEN s_suppkey % 3 = 0 THEN 'https://y.org/feed.json' END], lambda x: x IS NOT NULL), ' ') AS feeds
    FROM supplier
""")
def discovered_feeds(spark, d):
    k = F.col("s_suppkey")
    second = F.when(k % 2 == 0, F.lit("<LINK title=b REL='Alternate' type=application/atom+xml href='atom?a=1&amp;b=2'>")).otherwise(F.lit("<link rel=alternate type=text/html href=/no>"))
    third = F.when(k % 3 == 0, F.lit("<link type='application/feed+json' rel='me alternate' href='https://y.org/feed.json'>")).otherwise(F.lit("<link rel=stylesheet type=application/rss+xml href=/no.xml>"))
    page = said('<link rel="alternate" type="application/rss+xml" href="/s/', k, '.xml">', second, third, '<link rel="alternate" type="application/rss+xml" href="https://x.org/s/', k, '.xml">')
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(structure.discover_feeds.column(page, F.lit("https://x.org/blog/post")), " ").alias("feeds"))


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 2) AS declared FROM orders")
def declared_identities(spark, d):
    """Addresses with a DOI or an arXiv identifier, at the end or before a suffix, and two kinds without."""
    k = F.col("o_orderkey")
    u = (
        F.when(k % 5 == 0, said("https://x.org/doi/10.", 1000 + k % 9000, "/a", k))
        .when(k % 5 == 1, said("https://arxiv.org/abs/2401.", F.lpad((k % 100000).cast("string"), 5, "0"), "v2"))
        .when(k % 5 == 2, said("https://arxiv.org/pdf/2401.", F.lpad((k % 10000).cast("string"), 4, "0"), "?x=1"))
        .when(k % 5 == 3, said("https://x.org/2401/", k))
        .otherwise(said("https://x.org/v10.1/", k))
    )
    return table(spark, d, "orders").select("o_orderkey", urls.url_declares_identity(u).alias("declared"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'local file' WHEN 1 THEN 'x' || c_custkey || '.org' WHEN 2 THEN 'w.x.org' ELSE '' END AS domain FROM customer")
def address_domains(spark, d):
    k = F.col("c_custkey")
    u = F.when(k % 4 == 0, said("file:///tmp/", k, ".md")).when(k % 4 == 1, said(" HTTPS://www.X", k, ".org:8080/a")).when(k % 4 == 2, said("http://user@w.x.org/", k)).otherwise(said("notes ", k))
    return table(spark, d, "customer").select("c_custkey", urls.domain_of(u).alias("domain"))


@query("SELECT a.o_orderkey, bit_count(xor(a.o_orderkey::BIGINT * 1000003, a.o_custkey::BIGINT * 998244353)) AS bits FROM orders a")
def hamming_distances(spark, d):
    a, b = F.col("o_orderkey").cast("bigint") * 1000003, F.col("o_custkey").cast("bigint") * 998244353
    return table(spark, d, "orders").select("o_orderkey", hashing.hamming(a, b).alias("bits"))


@query("SELECT p_partkey, p_name || ' & ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' <b>' ELSE '' END AS line FROM part")
def inline_texts(spark, d):
    """Names in tags, over several lines; a twice escaped tag is text after one decoding and is not removed before it."""
    tail = F.when(F.col("p_partkey") % 2 == 0, F.lit(" &amp;lt;b&amp;gt;")).otherwise(F.lit(""))
    c = said("  <i>", F.col("p_name"), "</i>\n\t&amp;<br/>", F.col("p_brand"), tail)
    once = markup.decode_entities_udf(markup.clean_inline_udf(c))
    return table(spark, d, "part").select("p_partkey", once.alias("line"))


@query("SELECT p_partkey, true AS itself, false AS other FROM part")
def escaped_patterns(spark, d):
    """Text full of operators of regular expressions, escaped, matches itself as a whole and no variation of it."""
    t = said("(", F.col("p_name"), ")* [", F.col("p_partkey"), "]+ {2}|^$ a.b?\\")
    p = said("^", text.regexp_escape(t), "$")
    return table(spark, d, "part").select("p_partkey", F.regexp_like(t, p).alias("itself"), F.regexp_like(F.replace(t, F.lit("a.b"), F.lit("axb")), p).alias("other"))


# -- bytes --------------------------------------------------------------------------------------


@query("""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso-8859-15' WHEN 2 THEN 'shift_jis' END AS header,
           CASE s_suppkey % 3 WHEN 0 THEN 'koi8-r' WHEN 1 THEN 'gb2312' END AS page FROM supplier
""")
def charset_labels(spark, d):
    k = F.col("s_suppkey")
    header = F.when(k % 4 == 0, "text/html; charset=UTF-8").when(k % 4 == 1, "text/html;charset = 'ISO-8859-15'").when(k % 4 == 2, 'TEXT/HTML; CHARSET="Shift_JIS"; x=y').otherwise("text/html")
    page = F.when(k % 3 == 0, "<html><META charset='KOI8-R'>").when(k % 3 == 1, '<meta http-equiv="Content-Type" content="text/html; charset=gb2312">').otherwise("<p>charset=none")
    return table(spark, d, "supplier").select("s_suppkey", raw.content_type_charset(header).alias("header"), raw.html_charset(page).alias("page"))


@query("""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'application/rtf' WHEN 2 THEN 'application/epub+zip' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS fallback FROM supplier
""")
def document_content_types(spark, d):
    k = F.col("s_suppkey")
    t = F.when(k % 4 == 0, " Text/CSV; header=present").when(k % 4 == 1, "application/rtf").when(k % 4 == 2, "application/epub+zip;v=3").otherwise("text/html")
    f = table(spark, d, "supplier").select("s_suppkey", raw.doc_format_for_content_type(t).alias("f"))
    return f.select("s_suppkey", F.col("f.content_type").alias("kind"), F.col("f.text_fallback").alias("fallback"))


@query("""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'tool ' || s_name WHEN 2 THEN 'ocr ' || s_name ELSE '' END AS text,
           CASE s_suppkey % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'pdftotext' WHEN 2 THEN 'ocr' END AS extractor, CASE WHEN s_suppkey % 4 = 3 THEN 'no text layer (scanned or image-only PDF?)' END AS reason FROM supplier
""")
def pdf_rungs(spark, d):
    """The ladder over given rungs: a tool's good text wins, garbled text falls through, the last reason is told."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    native = F.when(k % 4 == 0, name).when(k % 4 == 1, name).otherwise("")
    tool = F.when(k % 4 == 1, said("tool ", name)).when(k % 4 == 0, F.lit("�" * 20)).otherwise("")
    ocr = F.when(k % 4 == 2, said("ocr ", name)).otherwise("  ")
    r = table(spark, d, "supplier").select("s_suppkey", raw.pdf_ladder(native, pdftotext=tool, ocr=ocr).alias("r"))
    return r.select("s_suppkey", "r.text", "r.extractor", "r.reason")


@query("""
    SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN s_name WHEN 1 THEN '<b>' || s_name WHEN 4 THEN s_name ELSE '' END AS text, CASE s_suppkey % 6 WHEN 0 THEN s_name END AS title,
           CASE s_suppkey % 6 WHEN 2 THEN 'not modified' WHEN 3 THEN 'status 404' WHEN 5 THEN 'no converter for this format' END AS note,
           CASE s_suppkey % 6 WHEN 0 THEN 'native' WHEN 1 THEN 'plain' WHEN 4 THEN 'native-pdf' END AS extractor FROM supplier
""")
def extraction_routes(spark, d):
    """The router's six ways: HTML, plain, not modified, failed, PDF by its first bytes, an office file that cannot be read."""
    k, name = F.col("s_suppkey") % 6, F.col("s_name")
    body = F.when(k == 0, said("<!DOCTYPE html><head><title>", name, "</title></head><nav>menu</nav><p>", name, "</p>")).when(k == 4, said("%PDF-1.4 stream\nBT (", name, ") Tj ET\nendstream")).otherwise(said("<b>", name))
    stored = table(spark, d, "supplier").select(
        "s_suppkey",
        said("https://x.org/f", k, F.when(k == 5, ".docx").otherwise("")).alias("url"),
        F.when(k == 2, 304).when(k == 3, 404).otherwise(200).alias("status"),
        F.when(k == 1, "text/plain").when(k == 0, "text/html").otherwise("application/octet-stream").alias("content_type"),
        F.encode(body, "UTF-8").alias("bytes"),
    )
    return raw.extract(stored).select("s_suppkey", "text", "title", "note", "extractor")


@query("""
    SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'any ' || s_name WHEN 1 THEN 'fire ' || s_name ELSE '' END AS text,
           CASE s_suppkey % 3 WHEN 0 THEN 'anydoc' WHEN 1 THEN 'firecrawl' END AS extractor, CASE WHEN s_suppkey % 3 = 2 THEN 'no converter for this format' END AS reason FROM supplier
""")
def document_rungs(spark, d):
    """The office ladder over given rungs: garbled and missing texts fall through, nothing readable is refused."""
    k, name = F.col("s_suppkey") % 3, F.col("s_name")
    rungs = {"anydoc": F.when(k == 0, said("any ", name)).when(k == 1, F.lit("�" * 20)), "firecrawl": F.when(k == 1, said("fire ", name)).when(k == 0, said("fire ", name))}
    r = table(spark, d, "supplier").select("s_suppkey", raw.doc_ladder(**rungs).alias("r"))
    return r.select("s_suppkey", "r.text", "r.extractor", "r.reason")


# -- what sites publish -------------------------------------------------------------------------


def _stored(rows: DataFrame, url: Column, status: Column, body: Column, kind: str) -> DataFrame:
    return rows.select(url.alias("url"), status.cast("int").alias("status"), F.lit(kind).alias("content_type"), F.encode(body, "UTF-8").alias("bytes"))


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS allowed, c_custkey % 4 <> 0 AS absent, CASE WHEN c_custkey % 4 = 0 THEN 1500 END::VARCHAR AS crawl_delay_ms FROM customer")
def stored_robots(spark, d):
    """Rules by origin: a file that forbids, none, a failed and a blank one; the failed one is no reason to stay away."""
    k, c = F.col("c_custkey"), table(spark, d, "customer").select("c_custkey")
    origin = said("https://h", k, ".org:8443")
    status = F.when(k % 4 == 1, 404).otherwise(200)
    body = F.when(k % 4 == 2, F.lit(" \n")).otherwise(F.lit("User-agent: *\nDisallow: /private\nCrawl-delay: 1.5\n"))
    files = _stored(c.where(k % 4 != 3), F.concat(origin, F.lit("/robots.txt")), status, body, "text/plain")
    pages = c.select("c_custkey", F.concat(origin, F.lit("/private/a")).alias("url"))
    r = site.robots_of(pages, files, "textmill")
    return r.select("c_custkey", structure.is_allowed("robots", "url").alias("allowed"), F.col("robots.absent").alias("absent"), F.col("robots.crawl_delay_ms").cast("string").alias("crawl_delay_ms"))


@query("""
    SELECT 'https://h' || s_suppkey || '.org/start' AS url, unnest([0, 2]) AS doc_no, 'https://h' || s_suppkey || '.org/' || unnest(['a', 'c']) AS loc FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 'https://h' || s_suppkey || '.org/start', 0, 'https://h' || s_suppkey || '.org/s' FROM supplier WHERE s_suppkey % 2 = 1
""")
def stored_sitemaps(spark, d):
    """Three documents a site: even sites name an index with pages and two further maps, the second of which is beyond the budget; odd ones have the usual address."""
    s = table(spark, d, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    at = lambda path: said("https://h", k, f".org/{path}")
    entry = lambda path: said("<url><loc>", at(path), "</loc></url>")
    index = said(entry("a"), "<sitemap><loc>", at("m2.xml"), "</loc></sitemap><sitemap><loc>", at("m3.xml"), "</loc></sitemap>")
    even, odd, ok = s.where(k % 2 == 0), s.where(k % 2 == 1), F.lit(200)
    stored = _stored(even, at("m1.xml"), ok, said("<urlset>", index, "</urlset>"), "text/xml")
    for rows, path, status, body in ((even, "m2.xml", ok, entry("c")), (even, "m3.xml", ok, entry("d")), (even, "sitemap.xml", F.lit(404), entry("x")), (odd, "sitemap.xml", ok, entry("s"))):
        stored = stored.unionByName(_stored(rows, at(path), status, said("<urlset>", body, "</urlset>"), "text/xml"))
    sites = s.select(at("start").alias("url"), F.when(k % 2 == 0, F.array(at("m1.xml"))).alias("sitemaps"))
    return site.sitemaps_of(sites, stored).select("url", "doc_no", "loc")


@query("SELECT 'https://x.org/f/' || s_suppkey AS url, CASE WHEN s_suppkey % 4 = 0 THEN 'atom' ELSE 'rss' END AS kind, s_name AS title, 'https://x.org/i/' || s_suppkey AS link FROM supplier WHERE s_suppkey % 4 IN (0, 1)")
def stored_feeds(spark, d):
    """Atom, RSS, a page that is no feed and a failed answer with the body of one."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    link = said("https://x.org/i/", k)
    atom = said('<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>', name, '</title><link href="', link, '"/></entry></feed>')
    rss = said("<rss><channel><title>F</title><item><title>", name, "</title><link>", link, "</link></item></channel></rss>")
    body = F.when(k % 4 == 0, atom).when(k % 4 == 2, F.lit("<html><body>none</body></html>")).otherwise(rss)
    f = site.feeds_of(_stored(table(spark, d, "supplier"), said("https://x.org/f/", k), F.when(k % 4 == 3, 500).otherwise(200), body, "text/xml"))
    return f.select("url", F.col("feed.kind").alias("kind"), F.explode("feed.items").alias("i")).select("url", "kind", "i.title", F.col("i.url").alias("link"))


@query("""
    SELECT 'https://x.org/j/' || c_custkey AS url, c_custkey % 4 <> 3 AS ok, CASE WHEN c_custkey % 4 IN (0, 3) THEN c_custkey::VARCHAR END AS n, CASE WHEN c_custkey % 4 = 1 THEN 'plain ' || c_custkey END AS text FROM customer
""")
def stored_json(spark, d):
    """JSON, text that is none, an empty body, and JSON of a failed request, which is told all the same."""
    k = F.col("c_custkey")
    body = F.when(k % 4 == 1, said("plain ", k)).when(k % 4 == 2, "").otherwise(said('{"n":', k, "}"))
    j = site.json_answers(_stored(table(spark, d, "customer"), said("https://x.org/j/", k), F.when(k % 4 == 3, 400).otherwise(200), body, "application/json"))
    return j.select("url", "ok", F.try_variant_get("data", "$.n", "string").alias("n"), "text")


# -- state --------------------------------------------------------------------------------------


@query("""
    SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'e' || event_id END AS etag, CASE WHEN event_id % 4 > 0 THEN 'm' || event_id END AS last_modified,
           CASE WHEN event_type <> 'error' AND event_id % 5 > 0 THEN sha256('b' || event_id) END AS content_hash, CASE WHEN event_id % 5 > 0 THEN length('b' || event_id) ELSE 0 END::BIGINT AS bytes
    FROM events
""")
def fingerprints(spark, d):
    """Observations with and without each validator, of successes and failures, empty bodies included."""
    k = F.col("event_id")
    seen = table(spark, d, "events").select(
        k.alias("url"),
        F.when(k % 3 == 1, said("e", k)).when(k % 3 == 2, said("e", k)).otherwise("").alias("etag"),
        F.when(k % 4 > 0, said("m", k)).alias("last_modified"),
        F.when(k % 5 > 0, said("b", k)).when(k % 2 == 0, "").alias("body"),
        F.when(F.col("event_type") == "error", 500).otherwise(204).alias("status"),
    )
    return state.fingerprint(seen).select(F.col("url").alias("event_id"), "etag", "last_modified", "content_hash", "bytes")


@query("""
    SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'e' || event_id END AS if_none_match, CASE WHEN event_id % 4 > 0 THEN 'm' || event_id END AS if_modified_since,
           (CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 4 > 0 THEN 1 ELSE 0 END) AS n FROM events
""")
def revalidation(spark, d):
    k = F.col("event_id")
    h = table(spark, d, "events").select("event_id", responses.revalidation_headers(F.when(k % 3 > 0, said("e", k)).otherwise(""), F.when(k % 4 > 0, said("m", k))).alias("h"))
    return h.select("event_id", F.try_element_at("h", F.lit("if-none-match")).alias("if_none_match"), F.try_element_at("h", F.lit("if-modified-since")).alias("if_modified_since"), F.size("h").alias("n"))


@query("""
    WITH RECURSIVE a AS (
        SELECT user_id AS host, event_id AS seq, epoch_us(ts) // 100000000 AS now_ms, CASE WHEN event_type = 'error' THEN 3000 ELSE 0 END AS back, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (
        SELECT host, seq, k, now_ms AS departs_ms, CASE WHEN back > 0 THEN greatest(now_ms + 400, now_ms + back) ELSE now_ms + 400 END AS free FROM a WHERE k = 1
        UNION ALL
        SELECT a.host, a.seq, a.k, greatest(a.now_ms, r.free), CASE WHEN back > 0 THEN greatest(greatest(a.now_ms, r.free) + 400, a.now_ms + back) ELSE greatest(a.now_ms, r.free) + 400 END
        FROM r JOIN a ON a.host = r.host AND a.k = r.k + 1)
    SELECT host, seq, departs_ms FROM r
""")
def host_back_off(spark, d):
    """Pacing with back-offs after errors, against the recurrence itself."""
    now = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 100000).cast("bigint")
    a = table(spark, d, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), now.alias("now_ms"), F.lit(400).cast("bigint").alias("delay_ms"), F.when(F.col("event_type") == "error", 3000).alias("back"))
    return state.host_slots(a, back_off_ms="back").select("host", "seq", "departs_ms")


# -- services -----------------------------------------------------------------------------------


@query("""
    SELECT asked, arg_min(registry, place) AS registry, arg_min(version, place) AS version FROM (
        SELECT p_partkey % 50 AS asked, CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'crates' END AS registry, p_partkey % 3 AS place, max('1.' || p_partkey) AS version
        FROM part GROUP BY ALL) GROUP BY asked
""")
def resolved_packages(spark, d):
    """Of each asked name the first registry that knows it; answers without a name know nothing."""
    k = F.col("p_partkey")
    registry = F.when(k % 3 == 0, "npm").when(k % 3 == 1, "pypi").otherwise("crates")
    p = table(spark, d, "part").groupBy((k % 50).alias("asked"), registry.alias("registry")).agg(F.max(said("1.", k)).alias("version")).withColumn("name", said("n", F.col("asked")))
    unknown = p.select("asked", F.lit("npm").alias("registry"), F.lit("0").alias("version"), F.lit(None).cast("string").alias("name")).distinct()
    return apis.resolve_packages(p.unionByName(unknown)).select("asked", "registry", "version")


@query("""
    WITH RECURSIVE n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 1 WHEN p_partkey % 50 = 48 THEN p_partkey + 1 WHEN p_partkey % 50 > 0 AND p_partkey % 50 < 40 THEN p_partkey - 1 END AS nxt FROM part),
    r AS (
        SELECT k, k AS here, 0 AS step FROM n
        UNION ALL SELECT r.k, n.nxt, step + 1 FROM r JOIN n ON n.k = r.here WHERE n.nxt IS NOT NULL AND step < 60)
    SELECT k AS p_partkey, 'o/r' || coalesce(max(here) FILTER (WHERE here NOT IN (SELECT k FROM n WHERE nxt IS NOT NULL)), k) AS canonical FROM r GROUP BY k
""")
def renamed_repositories(spark, d):
    """Chains of renames of up to 39 steps, and circles of two, in which a name stays what it is."""
    k = F.col("p_partkey")
    to = F.when(k % 50 == 48, k + 1).when((k % 50 == 49) | ((k % 50 > 0) & (k % 50 < 40)), k - 1)
    p = table(spark, d, "part").select(k, F.lit("o").alias("owner"), F.concat(F.lit("r"), k.cast("string")).alias("repo"), F.concat(F.lit("o/r"), to.cast("string")).alias("full_name"))
    return apis.canonical_repos(p.drop("full_name"), p.where("full_name is not null")).select("p_partkey", "canonical")


@query("""
    WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
    SELECT event_id, coalesce(o_orderkey, 0) AS o_orderkey FROM (SELECT *, ts - INTERVAL 26 YEAR AS back FROM events) e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.back >= o.o_orderdate
""")
def orders_at_events(spark, d):
    """The last order that each user had placed 26 years before an event happened, when the orders were placed."""
    events = table(spark, d, "events").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 26 YEAR")).alias("ts"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    joined = asof.asof_join(events, orders, "user_id", "ts", "o_custkey", "o_orderdate", tie="o_orderkey")
    return joined.select("event_id", F.coalesce("last.o_orderkey", F.lit(0)).alias("o_orderkey"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new/c' || c_custkey ELSE 'o/c' || c_custkey END AS canonical FROM customer")
def canonical_repositories(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("o").alias("owner"), said("c", F.col("c_custkey")).alias("repo"))
    renames = c.where("c_custkey % 3 = 0").select("owner", "repo", said("new/", F.col("repo")).alias("full_name"))
    return apis.canonical_repos(c, renames).select("c_custkey", "canonical")


@query("SELECT o_orderkey, unnest(['v' || o_orderkey, 'w']) AS title, unnest(['https://github.com/o/r/releases/tag/v' || o_orderkey, 'https://github.com/o/r/releases/tag/w']) AS url FROM orders")
def tag_lists(spark, d):
    body = said('[{"name":"v', F.col("o_orderkey"), '","commit":{"sha":"a"}},{"name":"w"}]')
    t = table(spark, d, "orders").select("o_orderkey", F.explode(apis.tags(body, F.lit("https://github.com/o/r"))).alias("t"))
    return t.select("o_orderkey", "t.title", "t.url")


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'github' WHEN 1 THEN 'github' WHEN 2 THEN 'gitlab' WHEN 3 THEN 'gitea' WHEN 4 THEN 'gitea' END AS kind FROM supplier")
def forge_kinds(spark, d):
    k = F.col("s_suppkey") % 6
    host = F.when(k == 0, "GitHub.com").when(k == 1, "api.github.com").when(k == 2, said("gitlab", F.col("s_suppkey"), ".example.org")).when(k == 3, "codeberg.org").when(k == 4, "git.forgejo.dev").otherwise("notgithub.com")
    return table(spark, d, "supplier").select("s_suppkey", apis.forge_kind(host).alias("kind"))


# -- stores -------------------------------------------------------------------------------------


def measured(batch: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: the length of a text, and how many blanks it has."""
    return [[float(len(t)), float(t.count(" "))] for t in batch]


@query("SELECT doc_id, length(coalesce(text, ''))::FLOAT AS chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::FLOAT AS blanks FROM documents")
def embedding_batches(spark, d):
    """Batches of 16 texts through a model, keyed by id."""
    v = store.embed(table(spark, d, "documents"), measured, id_col="doc_id")
    return v.select("doc_id", F.get("vector", F.lit(0)).alias("chars"), F.get("vector", F.lit(1)).alias("blanks"))


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS payload, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_upserts(spark, d):
    """All vectors inserted, every third one inserted again under another payload: the later one stays."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("vector"))
    size = len(e.first().vector)
    held = store.Collection(spark, work_path(spark, "collection"), size)
    held.upsert(e.withColumn("payload", F.lit("first")))
    held.upsert(e.where("id % 3 = 0").withColumn("payload", F.lit("second")))
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return held.read().select("id", "payload", F.round(total, 4).alias("total"))


@query("SELECT user_id AS path, arg_max('v' || event_id, event_id) AS content FROM events GROUP BY user_id")
def last_artifacts(spark, d):
    e = table(spark, d, "events")
    return store.last_per_path(e.select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), said("v", F.col("event_id")).alias("content")))


@query("SELECT event_id, CASE WHEN event_id % 4 > 1 THEN event_id::VARCHAR END AS n FROM events")
def tolerant_json(spark, d):
    """Malformed, absent and truncated text reads as nothing, good JSON as itself."""
    k = F.col("event_id")
    body = F.when(k % 4 == 0, F.lit('{"n":')).when(k % 4 == 1, F.lit(None)).otherwise(said('{"n":', k, "}"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(store.parsed_json(body), "$.n", "bigint").cast("string").alias("n"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 'shard,gone' ELSE 'shard,f' || (p_partkey // 10) || ',gone' END AS missing, CASE WHEN p_partkey % 3 = 0 THEN 'fast,slow-' || p_partkey || ',x' WHEN p_partkey % 3 = 1 THEN 'a,b' ELSE '' END AS listed FROM part
""")
def help_flags(spark, d):
    """Flags that a help text leaves out, heads of longer names among them, and the values it lists for one."""
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, said("| `--mode-all` x | `--mode`: `fast`\\|`slow-", k, "`\\| x | Y|Z")).when(k % 3 == 1, "--mode = a|b, or c|d").otherwise("--mode one, a|b")
    text_of = said("--shards N, --f", k, "; --f", k, "0\n", F.lit("--other"))
    flags = F.array(F.lit("shard"), F.lit("shards"), said("f", k), said("f", F.floor(k / 10)), F.lit("gone"))
    told = table(spark, d, "part").select(k, text.missing_from_help(text_of, flags).alias("missing"), text.piped_enum(line, F.lit("mode")).alias("listed"))
    return told.select("p_partkey", F.array_join("missing", ",").alias("missing"), F.coalesce(F.array_join("listed", ","), F.lit("")).alias("listed"))


@query("SELECT count(*) AS rows, sum(strlen(text))::BIGINT AS bytes, (count(*) FILTER (WHERE doc_id % 3 = 0))::BIGINT AS cached FROM documents")
def fetch_totals(spark, d):
    """Counters that fill up on the side while the fetched rows are written."""
    rows, seen = store.observed(table(spark, d, "documents").select("text", (F.col("doc_id") % 3 == 0).alias("cached")))
    written(rows, "fetched")
    told = seen.get
    return spark.createDataFrame([(told["rows"], told["bytes"], told["cached"])], "rows long, bytes long, cached long")

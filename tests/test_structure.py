import pytest
from pyspark.sql import functions as F

from textmill.functions import locale, structure
from textmill.operators import bitindex, ranking, state
from textmill.sources import apis, bytes as raw


def test_spans_are_copied_and_rows_padded():
    page = (
        "<table><caption>C &amp; D</caption><tr><th>a</th><th colspan=2>b</th></tr>"
        "<tr><td rowspan='2'>1</td><td>2</td><td>3</td></tr><tr><td>4<br>5</td></tr></table><table><tr><th>only</th></tr></table>"
    )
    assert structure.extract_tables(page) == [{"caption": "C & D", "headers": ["a", "b", "b"], "rows": [["1", "2", "3"], ["1", "4 5", ""]]}]


def test_a_row_label_makes_no_header():
    assert structure.extract_tables("<table><tr><th>k</th><td>v</td></tr></table>")[0]["headers"] == []
    wide = structure.extract_tables("<table><tr><td colspan=9999>x</td></tr></table>")[0]
    assert len(wide["rows"][0]) == 100


def test_metadata_prefers_embedded_json():
    page = """<script type="application/ld+json">{"@graph":[{"@type":["Article"],"headline":"H","author":[{"name":"A"},"B"],"publisher":{"name":"P"}}]}</script>
    <script type='application/ld+json'>{bad,}</script><meta property="og:title" content="no"><meta name="author" content="B"><meta name="description" content="d &amp; e"><title>T</title>"""
    m = structure.page_metadata(page)
    assert (m["title"], m["type"], m["authors"], m["site_name"], m["description"]) == ("H", "Article", ["A", "B"], "P", "d & e")
    assert structure.page_metadata("<title> x\n y </title>")["title"] == "x y"


def test_feeds():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><link rel="self" href="s"/><link href="u&amp;v"/><updated>2024</updated></entry></feed>'
    f = structure.parse_feed(atom)
    assert (f["kind"], f["title"], f["items"][0]["url"], f["items"][0]["published"]) == ("atom", "F", "u&v", "2024")
    assert structure.parse_feed("<html></html>") is None
    page = '<link rel="alternate" type="application/rss+xml" href="/f.xml"><link rel=stylesheet href=x>'
    assert structure.discover_feeds(page, "https://x.org/a/b") == ["https://x.org/f.xml"]


def test_sitemap_index():
    s = structure.parse_sitemap("<sitemapindex><sitemap><loc>https://x.org/1.xml</loc></sitemap></sitemapindex>")
    assert s == {"urls": [], "sitemaps": ["https://x.org/1.xml"]}


@pytest.mark.parametrize(
    ("agent", "path", "allowed"),
    [("mill", "/a/x", False), ("mill", "/a/x/ok", True), ("mill", "/q?x=1", False), ("other", "/a/x", True), ("other", "/z.html", False), ("other", "/z.html?x", True)],
)
def test_robots(spark, agent, path, allowed):
    body = "User-agent: mill\nDisallow: /a/\nAllow: /a/*/ok\nDisallow: /q?\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /*.html$\nSitemap: https://x.org/s.xml"
    r = spark.createDataFrame([(body, agent, f"https://x.org{path}")], "b string, a string, u string").withColumn("r", structure.parse_robots_udf("b", "a"))
    assert r.select(structure.is_allowed("r", "u")).first()[0] is allowed
    assert structure.parse_robots("", "x")["absent"] is True


def test_links():
    page = '<a href="b">1</a><a href="/b#x">2</a><a class=k href="mailto:x@y">3</a><a href="http://www.x.org/a/b/?utm_source=1">4</a><a href="http://[">5</a>'
    assert structure.links_from(page, "http://x.org/a/c") == ["http://x.org/a/b"]


def test_charsets():
    assert raw.decode_body(b"\x80\x93\x81", "text/html; charset=latin1") == "€“\x81"
    assert raw.decode_body("é".encode("utf-16-le"), "x; charset=utf-16le") == "é"
    assert raw.decode_body(b"\xef\xbb\xbf\xc3\xa9", "x; charset=latin1") == "é"
    assert raw.decode_body(b'<meta charset="iso-8859-1">\xe9') == '<meta charset="iso-8859-1">é'
    assert raw.decode_body(b"\xff", "x; charset=no-such") == "�"


def test_pdf_text_layer():
    import zlib

    packed = zlib.compress(b"BT [(He) -20 (llo) -300 (wor\\154d)] TJ T* <4142> Tj ET")
    assert raw.pdf_text(b"%PDF stream\n" + packed + b"\nendstream") == "Hello world\nAB"
    assert raw.pdf_text(b"garbage") == ""


def test_relevance_floor_and_fusion(spark):
    lists = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "b")], "list int, pos int, key string")
    got = {r.key: r.score for r in ranking.rrf(lists).collect()}
    assert got["b"] > got["a"] == pytest.approx(1 / 61)


def test_near_duplicates_collapse_like_the_greedy_pass(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base), (2, base.upper()), (3, base.replace("word5 ", "other ")), (4, " ".join(f"else{i}" for i in range(200))), (5, "short"), (6, "short")]
    items = spark.createDataFrame(rows, "rank int, text string")
    got = {r.rank: r.kept for r in ranking.dedupe_near_duplicates(items, max_bits=6).collect()}
    assert got[1] and not got[2] and got[4] and got[5] and got[6]


def test_diversity_is_a_permutation_led_by_the_best(spark):
    import numpy as np

    order = ranking.mmr_order(np.array([3.0, 2.9, 2.0]), [{"a", "b"}, {"a", "b"}, {"c"}], ["x", "y", "z"])
    assert order == [0, 2, 1] and ranking.mmr_order(np.array([1.0, 2.0]), [set(), set()], ["a", "b"]) == [0, 1]


def test_ranking_of_nothing(spark):
    empty = spark.createDataFrame([], "url string, title string, headings string, text string")
    assert ranking.rank_documents(empty, "needle").count() == 0
    one = spark.createDataFrame([("u", None, None, None)], "url string, title string, headings string, text string")
    assert ranking.rank_documents(one, "of the").count() == 0


def test_pacing_equals_the_recurrence(spark):
    import random

    rng = random.Random(5)
    rows = [(h, i, rng.randrange(3000), 400, rng.choice([0, 0, 1500])) for h in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "host string, seq int, now_ms long, delay_ms long, back long")
    got = {(r.host, r.seq): r.departs_ms for r in state.host_slots(df, back_off_ms="back").collect()}
    free = {}
    for h, i, now, delay, back in rows:
        at = max(now, free.get(h, 0))
        assert got[h, i] == at
        free[h] = max(at + delay, now + back) if back else at + delay


def test_crawl_budget_and_rules(spark):
    at = "https://x.org/p/{}".format
    pages = spark.createDataFrame([(at(i), f"t{i}", f"text {i}") for i in range(1, 30)], "url string, title string, text string")
    links = spark.createDataFrame([(at(i), k, at(2 * i + k)) for i in range(1, 15) for k in (0, 1)], "url string, pos int, link string")
    got = state.crawl(pages, links, at(1), max_pages=4, max_depth=3)
    assert [r.url for r in got["pages"].orderBy("depth", "place").collect()] == [at(1), at(2), at(3), at(4)]
    robots = spark.createDataFrame([("User-agent: *\nDisallow: /p/2",)], "b string").select(structure.parse_robots_udf("b", F.lit("mill")).alias("robots"))
    ruled = state.crawl(pages, links, at(1), robots=robots, max_pages=10, max_depth=1)
    assert [r.url for r in ruled["pages"].orderBy("depth", "place").collect()] == [at(1), at(3)]
    assert [r.url for r in ruled["disallowed"].collect()] == [at(2)]


def plain_walk(graph, texts, seed, refused, listed, most, deep):
    """First in, first out over ``graph`` (address to addresses); pages, pending and refused in order."""
    queue, seen = [(seed, 0)], {seed}
    for x in listed if deep else []:
        if x not in seen:
            seen.add(x)
            queue.append((x, 1))
    pages, gone = [], []
    while queue and len(pages) < most:
        at, depth = queue.pop(0)
        if at in refused:
            gone.append(at)
        elif texts.get(at):
            pages.append(at)
            for x in graph.get(at, []) if depth < deep else []:
                if x not in seen:
                    seen.add(x)
                    queue.append((x, depth + 1))
    return pages, sorted(x for x, _ in queue), sorted(gone)


@pytest.mark.parametrize("most, deep", [(1, 3), (5, 2), (9, 1), (50, 4), (3, 0)])
def test_walks_from_many_seeds_equal_the_plain_queue(spark, most, deep):
    import random

    rng = random.Random(most)
    at = "https://x.org/{}".format
    graph = {at(i): [at(rng.randrange(40)) for _ in range(rng.randrange(5))] for i in range(30)}
    texts = {at(i): "t" if i % 6 else "" for i in range(35)}
    pages = spark.createDataFrame([(u, "", t) for u, t in texts.items()], "url string, title string, text string")
    links = spark.createDataFrame([(u, k, v) for u, vs in graph.items() for k, v in enumerate(vs)], "url string, pos int, link string")
    seeds = [at(1), at(2), at(7), "https://nowhere.org/"]
    rules = spark.createDataFrame([(at(2), "User-agent: *\nDisallow: /3")], "seed string, b string").select("seed", structure.parse_robots_udf("b", F.lit("mill")).alias("robots"))
    listed = spark.createDataFrame([(at(7), k, u) for k, u in enumerate([at(9), at(7), "https://else.org/", at(11)])], "seed string, pos int, loc string")
    found = state.crawl_sites(pages, links, spark.createDataFrame([(s,) for s in [*seeds, at(1)]], "seed string"), rules, listed, max_pages=most, max_depth=deep)
    rows = {k: v.collect() for k, v in found.items()}
    for s in seeds:
        refused = {at(i) for i in range(40) if str(i).startswith("3")} if s == at(2) else set()
        want = plain_walk(graph, texts, s, refused, [at(9), at(7), at(11)] if s == at(7) else [], most, deep)
        got = [r.url for r in sorted((r for r in rows["pages"] if r.seed == s), key=lambda r: (r.depth, r.place))]
        assert (got, *(sorted(r.url for r in rows[k] if r.seed == s) for k in ("pending", "disallowed"))) == want


def test_commits_and_tags(spark):
    df = spark.createDataFrame([("abcdef1234", "abcdef1"), ("abcdef1234", "abcdef"), ("v1.10.0", "v1.9.9")], "a string, b string")
    assert [r[0] for r in df.select(apis.same_commit("a", "b")).collect()][:2] == [True, False]
    assert df.where("a like 'v%'").select(locale.compare_tags("a", "b")).first()[0] == 1


def test_search_pages_stop_where_nothing_is_new(spark):
    rows = [("q", 0, 0, "https://x.org/a"), ("q", 0, 1, "https://x.org/b"), ("q", 1, 0, "https://www.x.org/a/"), ("q", 2, 0, "https://x.org/c")]
    hits = spark.createDataFrame(rows, "query string, page int, pos int, url string")
    assert sorted(r.url for r in apis.paged_hits(hits).collect()) == ["https://x.org/a", "https://x.org/b"]


def _drifting(n, step=4, size=300):
    words = [f"term{i * 7919 % 100003}" for i in range(n * step + size)]
    return [" ".join(words[i * step : i * step + size]) for i in range(n)]


def test_long_chains_of_near_copies_settle_like_the_greedy_pass(spark):
    from textmill.functions.hashing import simhash_of

    texts = _drifting(220)
    h = [simhash_of(t.split()) & 2**64 - 1 for t in texts]
    bits = 14
    want = ranking.greedy_keep(len(h), [(a, b) for b in range(len(h)) for a in range(b) if (h[a] ^ h[b]).bit_count() <= bits])
    items = spark.createDataFrame(list(enumerate(texts)), "rank int, text string")
    got = ranking.dedupe_near_duplicates(items, max_bits=bits, max_rounds=3).collect()
    assert [r.kept for r in sorted(got, key=lambda r: r.rank)] == want.tolist() and not want.all()


def test_copies_do_not_fill_the_pool(spark):
    best = "needle thread " * 50
    rows = [(f"a{i:03}", "", "", best) for i in range(60)] + [(f"b{i}", "", "", "needle " + " ".join(f"w{i}x{k}" for k in range(200))) for i in range(9)]
    docs = spark.createDataFrame(rows, "url string, title string, headings string, text string")
    got = [r.url for r in ranking.rank_documents(docs, "needle thread", limit=10).collect()]
    assert got[0] == "a000" and sorted(got[1:]) == [f"b{i}" for i in range(9)]


def test_near_copies_do_not_fill_the_pool(spark):
    from textmill.functions.hashing import simhash_of

    base = ["needle", *(f"w{k}" for k in range(900))]
    copies = [" ".join([*base[:-1], f"end{i}"]) for i in range(60)]
    near = [t for t in copies if ((simhash_of(t.split()) ^ simhash_of(copies[0].split())) & 2**64 - 1).bit_count() <= 3]
    rows = [(f"a{i:03}", "needle", "", t) for i, t in enumerate(near)] + [("b", "", "", "needle short"), ("c", "", "", "other")]
    docs = spark.createDataFrame(rows, "url string, title string, headings string, text string")
    got = [r.url for r in ranking.rank_documents(docs, "needle", limit=3).collect()]
    assert len(near) > 20 and len([u for u in got if u[0] == "a"]) == 1 and {"b", "c"} <= set(got)


def test_hybrid_ranks_documents_without_a_vector(spark):
    rows = [(1, "1", "", "", "other words", [1.0, 0.0]), (2, "2", "", "", "needle needle", None), (3, "3", "", "", "more words", [0.0, 1.0])]
    docs = spark.createDataFrame(rows, "pos int, id string, title string, headings string, body string, vec array<double>")
    got = {r.id: r for r in ranking.hybrid_search(docs, "needle", [1.0, 0.0]).collect()}
    assert set(got) == {"1", "2", "3"} and got["2"].dense_rank is None and got["2"].lexical_rank == 1
    assert got["2"].score == pytest.approx(1 / 61) and (got["1"].dense_rank, got["3"].dense_rank) == (1, 2)


def test_hybrid_query_ranks_every_document(spark, sf, monkeypatch):
    from textmill.plans import registry

    seen = []
    monkeypatch.setattr(registry.ranking, "hybrid_search", lambda docs, *a, **k: seen.append(docs.count()) or docs.withColumn("score", F.lit(0.0)))
    registry.QUERIES["hybrid_search"](spark, sf)
    assert seen == [spark.read.parquet(f"{sf}/documents.parquet").count()]


def test_near_duplicate_pairs_against_brute_force(spark, sf):
    from textmill.functions import hashing, text
    from textmill.plans.registry import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") >= 500)
    h = {r.doc_id: r.h & 2**64 - 1 for r in docs.select("doc_id", hashing.simhash(text.terms("text")).alias("h")).collect()}
    head = {}
    for i in sorted(h):
        head.setdefault(h[i], i)
    heads = sorted(head.values())
    want = {(a, b, (h[a] ^ h[b]).bit_count()) for a in heads for b in heads if a < b and (h[a] ^ h[b]).bit_count() <= 12}
    want |= {(head[h[i]], i, 0) for i in h if head[h[i]] != i}
    got = [tuple(r) for r in QUERIES["near_duplicate_pairs"](spark, sf).select("a", "b", "bits").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("bits", [0, 3, 8, 12])
def test_pairs_of_split_parts(spark, bits):
    import random

    rng = random.Random(4)
    h = [sum(1 << b for b in rng.sample(range(64), 8)) for _ in range(300)]
    h += [h[0] ^ (1 << b) for b in range(40)] + [h[1] ^ 3 ^ (7 << b) for b in range(5, 60)]  # drifting copies share most blocks
    n = len(h)
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    items = spark.createDataFrame([*enumerate(signed), (None, 5), (999, None)], "id long, h long")
    got = [tuple(r) for r in bitindex.hash_pairs(items, "id", "h", bits, held=64).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b, (h[a] ^ h[b]).bit_count()) for b in range(n) for a in range(b) if (h[a] ^ h[b]).bit_count() <= bits}


def test_blocks_follow_the_number_of_hashes():
    few, many = bitindex.best_blocks(1000, 12), bitindex.best_blocks(10**8, 12)
    assert len(few) > len(many) and sum(w for _, w, _ in bitindex.blocks_of(12, 5)) == 64
    for n in (10, 10**4, 10**6):
        blocks = bitindex.best_blocks(n, 12)
        assert sum(r + 1 for _, _, r in blocks) == 13  # pigeonhole: a pair that every block misses is 13 bits apart
    assert sorted(bitindex.masks(4, 2)) == [v for v in range(16) if v.bit_count() <= 2]


def test_every_turn_of_a_conversation_is_diversified(spark, sf):
    from textmill.plans.registry import QUERIES

    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    got = QUERIES["diversified"](spark, sf)
    assert got.count() == got.select("conv_id", "place").distinct().count() == turns.count()


def test_meta_values_without_quotes_and_empty_names():
    assert structure.meta_tags("<meta name=author content=Bob>") == {"author": "Bob"}
    assert structure.meta_tags('<meta property="" name="og" content="x"><meta name=og content=y><meta name=n content="">') == {"og": "x"}
    assert structure.page_metadata("<meta name=author content=Bob><meta property=og:title content=T>")["authors"] == ["Bob"]


def test_cells_rows_and_captions_over_marks():
    page = """<table><caption>A <b>b</b></caption><tr><th>h</th><th>i</th></tr><tr></tr>
      <tr><td rowspan=2>x<br>y &amp;lt; &#65;&#x42;</td><td colspan='0'>p</td></tr><tr><td>q<td>r</td></tr><tr><td>open</table>
      <table><tr><th>only</th></tr></table><table><tr><td colspan="999">w</td></tr></table>"""
    first, second = structure.extract_tables(page)
    assert first == {"caption": "A b", "headers": ["h", "i"], "rows": [["x y &lt; AB", "p"], ["x y &lt; AB", "qr"]]}
    assert second["headers"] == [] and len(second["rows"][0]) == 100


def test_embedded_objects_over_marks():
    page = """<script>"<script type='application/ld+json'>[9]"</script><script id=a type="application/ld+json"><!-- {"a": "</b>"} --></script>
      <script type='application/ld+json'>{"@graph": [1, {"b": 2}]}</script><script type="application/ld+json">{bad</script><script type="application/ld+json"> </script>"""
    assert structure.json_ld(page) == [{"a": "</b>"}, 1, {"b": 2}]


def test_content_containers_by_name():
    from textmill.functions.markup import main_html

    body = "long enough text " * 60
    for given in ("class='x main-content'", 'id="post"', "class=markdown-body", 'class="a entry"'):
        assert main_html(f"<div>menu</div><div {given}><div>{body}</div></div>") == f"<div>{body}</div>"
    for given in ("class=maintain", "id=contents", 'class="body markdown"', "title=content"):
        page = f"<div {given}>{body}</div>"
        assert main_html(page) == page
    assert main_html(f"<section class=content>{body}</section><article>{body}</article>") == body


def test_charset_of_headers_and_pages():
    assert raw.charset_parameter("text/html; Charset = 'UTF-8'; x") == "utf-8" and raw.charset_parameter("text/html") is raw.charset_parameter(None) is None
    assert raw.declared_in("<META http-equiv=x content='text/html; charset=koi8-r'>") == "koi8-r" and raw.declared_in('<meta name=a><meta charset="latin1">') == "latin1"
    assert raw.decode_body("é".encode("cp1252"), 'text/html;charset="iso-8859-1"') == "é" and raw.declared_in(None) is None

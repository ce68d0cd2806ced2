from pyspark.sql import functions as F
from pyspark.sql import Row

from textmill.functions import citations, hashing, text, urls
from textmill.functions.markup import cap_extract, clean_inline, decode_entities, focused_snippet, html_to_text, main_html


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if not isinstance(v, int) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()[0]


def test_terms_fold_accents_plurals_and_drop_stopwords(spark):
    assert one(spark, text.terms("t"), t="The réponses, boxes queries glass être Être a_b") == ["repons", "box", "query", "glass", "a_b"]
    assert one(spark, text.terms("t"), t=None) == []


def test_terms_equal_on_both_sides(spark):
    said = "Générateur parseQuery des requêtes naïve Straßen ØÆ łódź 2024 ID_TOKENS"
    assert [t for t in dict.fromkeys(one(spark, text.terms("t"), t=said))] == text.query_terms(said)


def test_keywords_keep_first_spelling(spark):
    assert one(spark, text.keywords("t"), t="HTTP http Server the server x") == ["HTTP", "Server"]
    assert one(spark, text.ranked_keywords("t"), t="plain rank2 parseQuery") == ["rank2", "parseQuery", "plain"]


def test_subtokens(spark):
    assert one(spark, text.subtokens("t"), t="parseHTTPQuery2json") == ["parse", "http", "query", "json"] == text.py_subtokens("parseHTTPQuery2json")
    assert one(spark, text.subtokens("t"), t="word") == []


def test_matcher_sees_accents_and_parts(spark):
    m = text.build_matcher("generateur parseQuery")
    assert one(spark, m.hits("t"), t="Le Générateur d'idées") == ["generateur"]
    assert one(spark, m.coverage("t"), t="a query generateur") == 1.0
    assert one(spark, m.canonical_of("t"), t="GÉNÉRATEUR") == "generateur"
    assert one(spark, text.build_matcher("what is it").coverage("t"), t="x") == 0.0


def test_excerpts_do_not_overlap_and_fall_back(spark):
    body = "# Head\n" + "\n".join(f"line {i}" for i in range(40)) + "\nneedle here\n```\n# not a head\n```\nneedle again"
    got = one(spark, text.excerpt_windows("t", ["needle"]), t=body)
    assert [g.anchor for g in got] == [41] and got[0].heading == "Head" and got[0].score == 1
    top = one(spark, text.excerpt_windows("t", ["absent"]), t="a\nb")
    assert top[0].score == 0 and top[0].snippet == "a\nb"


def test_fnv_and_simhash(spark):
    assert one(spark, hashing.fnv1a64("t"), t="") == "cbf29ce484222325"
    assert one(spark, hashing.fnv1a64("t"), t="a") == "af63dc4c8601ec8c"
    assert int(hashing.hash_units(["é😀"])[0]) == int(one(spark, hashing.fnv1a64("t"), t="é😀"), 16)
    assert hashing.simhash_of([]) == 0
    words = [f"w{i}" for i in range(300)]
    near, far = hashing.simhash_of(words), hashing.simhash_of([*words[:-3], "x", "y", "z"])
    assert ((near ^ far) & (2**64 - 1)).bit_count() < 12


def test_canonical_url():
    c = urls.canonical_url
    assert c("HTTPS://www.Example.com:443/Path/?utm_source=x&b=2&a=1#f") == "https://example.com/Path?a=1&b=2"
    assert c("http://example.com/a%26b?q=x%26y&ref=z") == "http://example.com/a%26b?q=x%26y"
    assert c("not a url/#x") == "not a url" and c(None) is None
    assert c(c("http://www.x.org/a/b/?z=1&y=2")) == c("http://www.x.org/a/b/?z=1&y=2")


def test_url_facts(spark):
    assert one(spark, urls.domain_of("t"), t="file:///tmp/x") == "local file"
    assert one(spark, urls.domain_of("t"), t="::bad") == ""
    assert one(spark, urls.arxiv_id("t"), t="https://arxiv.org/pdf/math.GT/0309136v1") == "math.gt/0309136"
    assert one(spark, urls.arxiv_id("t"), t="https://example.org/abs/2405.12345") is None
    assert one(spark, urls.looks_like_pdf("t"), t="https://arxiv.org/pdf/2502.19732v4") is True
    assert one(spark, urls.is_citable_url("t"), t="https://x.org/a?format=json") is False
    assert one(spark, urls.addressed_id_count("t"), t="https://x.org/?pmid=1,2+3") == 3


def test_entities_are_decoded_once():
    assert decode_entities("&amp;lt; &Dagger;&dagger; &nope; &#x41;&#66;&#99999999;") == "&lt; ‡† &nope; AB "
    assert clean_inline("R&amp;D &lt;i&gt;P53&lt;/i&gt;") == "R&D P53"


def test_html_text_and_main_region():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><main><h2>Hi</h2><ul><li>one<li>two</ul><div>a<div>b</div>c</div></main><script>x</script></body></html>"
    assert html_to_text(page) == "## Hi\none\ntwo\na\nb\nc"
    assert "menu" not in html_to_text(main_html(page.replace("one", "one " * 200)))
    assert main_html("<p>x</p>") == "<p>x</p>"


def test_caps_and_snippets(spark):
    assert one(spark, cap_extract("t", "summary"), t="x" * 4100).endswith("x\n\n… [truncated]")
    assert one(spark, cap_extract("t", "deep"), t="x" * 9000) == "x" * 9000
    got = one(spark, focused_snippet("t", "needle"), t="# Part\nThis sentence is about nothing. The needle is in this one. Another closing sentence.")
    assert got == "Part — The needle is in this one."


def test_claim_units():
    report = "# T\nOne claim [S1]\nsame paragraph.\n\n- item a\n  more\n- item b\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n> quoted\n> twice\n```\ncode [S9]\n```\n<!-- hidden [S8] -->\n---\nlast `x [S7]`"
    units = citations.claim_units(report)
    assert [u["text"] or u["items"] for u in units] == ["One claim [S1] same paragraph.", ["item a more", "item b"], "1 2", "quoted twice", "last  "]
    assert citations.claim_units(report, quotes="prose")[3]["text"] == "quoted twice"


def test_citations_and_figures(spark):
    got = one(spark, citations.collect_citations("t"), t="Claim [S1][x](y).\n\n```\n[S2]\n```\n[S3](link) [S1]")
    assert (got.grounding, got.inert_only) == (["S1"], ["S2"])
    assert one(spark, citations.numerals("t"), t="1 234 and 3,5% of 7 [S12] `88` 1'000") == ["1234", "3.5", "1000"]
    assert one(spark, citations.file_line("t"), t="a/b.py:9-3") is None
    assert one(spark, citations.file_line("t"), t="a/b.py:9") == Row(path="a/b.py", start=9, end=9)


def test_masks(spark):
    lines = F.split("t", "\n")
    assert one(spark, citations.code_mask(lines), t="a\n```\nb\n```\nc") == [False, True, True, True, False]
    assert one(spark, citations.appendix_mask(lines), t="# A\n## Sources\nx\n### s\n## B") == [False, True, True, True, False]
    got = one(spark, citations.marked_quote_mask(lines, "MARK"), t="> a\n> MARK\nx\n> b")
    assert (got.mask, got.regions) == ([True, True, False, False], 1)
    assert one(spark, citations.or_masks(citations.code_mask(lines), citations.appendix_mask(lines)), t="## References\n```") == [True, True]


def test_flags_of_help_texts(spark):
    from textmill.functions import text

    df = spark.createDataFrame([("use --run-root or --shards; --a.b x", "--mode `fast` \\| `slow` | x-1, --mode a|b"), (None, None)], "h string, l string")
    got = df.select(
        text.help_covers_flag("h", F.lit("run")).alias("head"), text.help_covers_flag("h", F.lit("shards")).alias("whole"), text.help_covers_flag("h", F.lit("a.b")).alias("escaped"), text.help_covers_flag("h", F.lit("axb")).alias("dot"),
        text.missing_from_help("h", F.array(F.lit("shards"), F.lit("shard"))).alias("missing"), text.piped_enum("l", F.lit("mode")).alias("listed"), text.piped_enum("l", F.lit("other")).alias("none"),
    ).collect()
    assert tuple(got[0]) == (False, True, True, False, ["shard"], ["fast", "slow", "x-1"], None)
    assert tuple(got[1]) == (False, False, False, False, ["shards", "shard"], None, None)

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from textmill.__main__ import main
from textmill.functions import citations
from textmill.operators import numbering, ranking
from textmill.sources import site
from textmill.sources.responses import fetch_one, register

REPORT = "intro [S1]\n## Sources\n- listed [S2]\n# Next `x`\n| a | b |\n|---|---|\n| 1 | 2 |\nend"


def test_excluded_lines_are_no_claims_and_headings_tag_sections():
    mask = [line.startswith("- ") for line in REPORT.split("\n")]
    tag = lambda h: h.strip("# ") if "Next" in h else None
    units = citations.claim_units(REPORT, mask, section_tag=tag)
    assert [(u["text"], u.get("section")) for u in units] == [("intro [S1]", None), ("1 2", "Next"), ("end", "Next")]
    assert len(citations.claim_units(REPORT, [])) == 4 and citations.claim_units("", [True]) == []
    table_head = citations.claim_units("| a |\n|---|\n", [False, True])
    assert [u["text"] for u in table_head] == ["a"]


def test_masked_citations(spark):
    df = spark.createDataFrame([(REPORT,), (None,), ("",)], "r string")
    c = citations.collect_citations("r", exclude=citations.appendix_mask(F.split("r", "\n")))
    got = [(r.c.grounding, r.c.inert_only) for r in df.select(c.alias("c")).collect()]
    assert got[0] == (["S1"], ["S2"]) and got[2] == ([], [])


def test_batches_of_a_whole_table(spark):
    df = spark.range(0, 103, numPartitions=5).select((F.col("id") * 37 % 103).alias("k"))
    got = {r.k: r.batch for r in numbering.to_batches(df, 10, [F.col("k")]).collect()}
    assert got == {k: k // 10 for k in range(103)}
    assert {r.batch for r in numbering.to_batches(df.where("k < 3"), 0, [F.col("k")]).collect()} == {0, 1, 2}
    assert numbering.to_batches(df.limit(0), 4, [F.col("k")]).count() == 0


@pytest.mark.parametrize("asked,floor", [(["a", "2024"], 3), (["a", "2024"], 0), (["2024", "7"], 1), (["a"], 1)])
def test_relevance_floor_keeps_the_order(spark, asked, floor):
    rows = [(1, ["2024"]), (2, ["a"]), (3, None), (4, ["a", "2024"]), (5, [])]
    got = {r["rank"]: (r.kept, r.place) for r in ranking.relevance_floor(spark.createDataFrame(rows, "rank int, matched array<string>"), asked, floor).collect()}
    if len(asked) < 2 or "a" not in asked:
        assert got == {i: (True, i) for i in range(1, 6)}
    else:
        assert [i for i, _ in sorted(got.items(), key=lambda x: x[1][1])] == [2, 4, 1, 3, 5]
        assert sorted(i for i in got if got[i][0]) == ([1, 2, 4] if floor == 3 else [2, 4])


def test_sites_without_anything(spark):
    stored = spark.createDataFrame([("https://a.org/sitemap.xml", 200, None, bytearray(b"<bad")), ("https://a.org/sitemap.xml", 200, "text/xml", None)], "url string, status int, content_type string, bytes binary")
    sites = spark.createDataFrame([("https://a.org/", None), ("nowhere", ["https://a.org/x"]), (None, None)], "url string, sitemaps array<string>")
    assert site.sitemaps_of(sites, stored).count() == 0 and site.sitemaps_of(sites.limit(0), stored.limit(0)).count() == 0
    ruled = site.robots_of(sites, stored, "textmill").collect()
    assert len(ruled) == 3 and all(r.robots.absent for r in ruled)
    assert [r.feed.kind for r in site.feeds_of(stored).collect()] == [None]
    assert [(r.data, r.text) for r in site.json_answers(stored.where("bytes is null")).collect()] == [(None, None)]


def test_sitemaps_that_name_each_other_end(spark):
    index = lambda *to: bytearray(("<sitemapindex>" + "".join(f"<sitemap><loc>https://a.org/{t}</loc></sitemap>" for t in to) + "</sitemapindex>").encode())
    page = bytearray(b"<urlset><url><loc>https://a.org/p</loc><lastmod>2024</lastmod></url></urlset>")
    rows = [("https://a.org/sitemap.xml", 200, "", index("b.xml", "sitemap.xml")), ("https://a.org/b.xml", 200, "", index("sitemap.xml", "c.xml")), ("https://a.org/c.xml", 200, "", page)]
    stored = spark.createDataFrame(rows, "url string, status int, content_type string, bytes binary")
    sites = spark.createDataFrame([("https://a.org/x", None)], "url string, sitemaps array<string>")
    assert site.sitemaps_of(sites, stored, 2).count() == 0
    assert [(r.doc_no, r["loc"], r.lastmod) for r in site.sitemaps_of(sites, stored, 9).collect()] == [(2, "https://a.org/p", "2024")]


@pytest.fixture
def echo():
    seen = []

    class Echo(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers.get("content-length") or 0)).decode()
            seen.append((self.command, body, {k.lower(): v for k, v in self.headers.items()}))
            busy = self.path == "/busy" and len(seen) < 3
            self.send_response(503 if busy else 200)
            self.send_header("retry-after", "0")
            self.end_headers()
            self.wfile.write(json.dumps({"got": body}).encode())

        do_GET = do_PUT = do_POST

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_requests_with_a_body(echo):
    at, seen = echo
    row = fetch_one(f"{at}/a", method="PUT", body='{"q":1}', headers={"Authorization": "Bearer t", "User-Agent": "me"})
    assert row[1] and json.loads(row[4]) == {"got": '{"q":1}'}
    command, body, headers = seen[0]
    assert (command, body, headers["content-type"], headers["authorization"], headers["user-agent"]) == ("PUT", '{"q":1}', "application/json", "Bearer t", "me")


def test_busy_servers_are_asked_again(echo):
    at, seen = echo
    assert fetch_one(f"{at}/busy", retries=0)[2] == 503 and len(seen) == 1
    assert fetch_one(f"{at}/busy", retries=3)[2] == 200 and len(seen) == 3


def test_source_with_options(spark, echo):
    register(spark)
    got = spark.read.format("responses").option("urls", f"{echo[0]}/a").option("method", "post").option("body", "{}").option("header.x-y", "z").load().collect()
    assert got[0].ok and echo[1][0][0] == "POST" and echo[1][0][2]["x-y"] == "z"


def test_commands_over_files(spark, tmp_path, capsys):
    (tmp_path / "a.html").write_text("<html><head><title>T</title></head><body><p>Hello there</body></html>")
    (tmp_path / "r.md").write_text("Claim [S1].\n\n```\n[S2]\n```\n")
    assert main(["extract", str(tmp_path / "a.html")]) == 0
    assert json.loads(capsys.readouterr().out)["text"] == "Hello there"
    assert main(["cite", str(tmp_path / "r.md")]) == 0
    told = json.loads(capsys.readouterr().out)
    assert (told["grounding"], told["inert_only"], told["claims"]) == (["S1"], ["S2"], 1)

"""Small cases behind the findings of the third round."""

import duckdb
import pyarrow as pa
import pytest

from textmill.functions import batched, hashing, markup, text
from textmill.operators import numbering, state
from textmill.plans.catalog import BATCH, table
from textmill.plans.registry import ORACLE_SQL, QUERIES


def test_of_entries_of_equal_age_the_first_counts(spark):
    rows = [("u", f"v{i}", i, "e", 1000) for i in (7, 3, 5)] + [("u", "old", 1, "e", 999)]
    held = spark.createDataFrame(rows, "url string, text string, seq long, etag string, cached_at long").repartition(3)
    got = spark.createDataFrame([("u", 500, "")], "url string, status int, text string")
    for _ in range(3):
        assert state.read_through(got.select("url"), held, got, 2000, 5000).first().text == "v3"


def test_titles_read_the_entities_of_their_sql(spark, tmp_path):
    pages = [(1, "u", "<title>a &lt;b&gt; &amp; &quot;c&quot; &#39;d</title>"), (2, "u", "<title> &amp;lt; &amp;quot; &x </title>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["html_titles"]).fetchall())
    assert sorted(map(tuple, QUERIES["html_titles"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("told", [0, 50_000])
def test_walks_tell_no_large_table_to_all_tasks(spark, sf, monkeypatch, told):
    monkeypatch.setattr(state, "TOLD_ROWS", told)
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{sf}/supplier.parquet'")
    got = QUERIES["sites_crawl"](spark, sf)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    want = con.execute(ORACLE_SQL["sites_crawl"]).df()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))


def test_parts_of_one_file_are_read_by_all_cores(spark, sf):
    """One small file is one task; what is made of its rows must not be."""
    plan = QUERIES["metadata_round_trip"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_workers_hold_small_batches_and_few_words(spark, sf):
    """What a worker holds depends neither on the rows of a partition nor on the vocabulary."""

    def sizes(it):
        for batch in it:
            yield batch.slice(0, 1).select([]).append_column("n", pa.array([batch.num_rows]))

    rows = table(spark, sf, "lineitem").select("l_orderkey").coalesce(1)
    held = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(held) == rows.count() and max(held) <= BATCH
    many = " ".join(f"w{i}x" for i in range(70_000))
    assert len(text.text_terms(many)) == 70_000 and len(text._FOLDED) <= 1 << 16


def test_sliced_columns_keep_order_nulls_and_kinds(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"a{i} b{i}") for i in range(900)], "i int, t string").coalesce(1)
    words = batched.per_value("array<string>", lambda t: t.split())
    pairs = batched.per_value("map<string,int>", lambda t: {"n": len(t)})
    record = batched.per_record("struct<a:string,b:array<int>>", ["a", "b"], lambda t, i: t and {"a": t, "b": [i]})
    for r in rows.select("i", words("t").alias("w"), pairs("t").alias("p"), record("t", "i").alias("r")).collect():
        said = None if r.i % 7 == 0 else f"a{r.i} b{r.i}"
        assert r.w == (said and said.split()) and r.p == (said and {"n": len(said)})
        assert r.r == ((said, [r.i]) if said else (None, None))


def test_repeated_parts_of_excerpts_are_worked_out_once(spark):
    """Work grows with the lines of a text, not with the places of the plan that name them."""
    docs = spark.createDataFrame([("x",)], "text string")
    for column in (markup.focused_snippet("text", "thering enten"), text.excerpt_windows("text", ["thering enten"])):
        plan = docs.select(column.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 + ("(?<=[.!?])" in plan)


def test_headings_of_fenced_and_many_lines(spark):
    said = ["a", "# one #", "b", "```", "# no", "~~~", "c", "## two", "", "#", "# ", "#three", "  ```", "# hid", "```", "x", "# last"]
    want, fence, now = [], False, None
    for line in said * 20:
        toggles = line.strip()[:3] in ("```", "~~~")
        if not toggles and not fence and line.startswith(("# ", "## ")) and line.strip("# "):
            now = line.strip("# ")
        fence ^= toggles
        want.append(now)
    rows = spark.createDataFrame([("\n".join(said * 20), 1), ("", 2), (None, 3)], "t string, i int")
    got = rows.orderBy("i").select(text.nearest_headings(text.line_rows("t")).alias("h")).collect()
    assert [r.h for r in got] == [want, [None], None]


def test_renames_are_not_told_to_all_tasks(spark, sf):
    plan = QUERIES["renamed_repositories"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_text_is_trimmed_once_and_long_runs_are_told_by_code_points(spark):
    long, short = "#" * 300 + "𝔸", "#" * 299 + "𝔸"
    rows = spark.createDataFrame([(1, f"  {long} # "), (2, short + " #"), (3, None), (4, "a" * 400)], "i int, t string")
    got = rows.select("i", markup.assess_text("t").alias("v"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("coalesce(t") == 1
    assert [(r.i, r.v.ok) for r in got.orderBy("i").collect()] == [(1, False), (2, True), (3, False), (4, True)]


def test_near_duplicates_sort_no_text_and_hash_each_once(spark, sf, monkeypatch):
    sorted_columns = []
    ranked = numbering.ranked
    monkeypatch.setattr(numbering, "ranked", lambda df, *rest: sorted_columns.append(df.columns) or ranked(df, *rest))
    kept = QUERIES["near_duplicate_collapse"](spark, sf)
    assert sorted_columns == [["doc_id", "n", "hash"]]
    assert "Python" not in kept._jdf.queryExecution().sparkPlan().toString()


def test_hashes_of_texts_are_those_of_their_terms(spark):
    texts = ["", None, "one", "one two", "alpha beta gamma delta", "\U0001d400x café \U0001f600 naïve words " * 40, "a b c"] * 12
    got = [r.h for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(hashing.text_simhash("t").alias("h")).collect()]
    assert got == [None if t is None else hashing.simhash_of(text.text_terms(t)) for t in texts]
    one = hashing.simhash_of(["alpha", "beta", "gamma"])
    assert one & ((1 << 64) - 1) == int(hashing.hash_units(["alpha beta gamma"])[0])

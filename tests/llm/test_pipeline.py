"""The pipeline's stages, each against its own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, kept[-1], sf).write.parquet(path)
        kept.append(spark.read.parquet(path))
    return kept


def test_stages_keep_the_columns_and_only_ever_drop_rows(stages):
    for before, after in zip(stages[:4], stages[1:5]):
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0
    assert stages[4].count() == stages[3].count()  # mixing orders, it drops nothing


def test_no_copies_stay(stages):
    white = str.maketrans("", "", " \t\n\x0b\x0c\r")
    before = {(r.text or "").translate(white) for r in stages[1].collect()}
    after = [(r.text or "").translate(white) for r in stages[2].collect()]
    assert sorted(after) == sorted(before)


def test_near_copies_against_brute_force(stages):
    from textmill.llm.simhash_bk import jaccard, shingle_set

    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)


def test_all_that_is_mixed_is_packed(stages):
    assert {r.doc_id for r in stages[5].select("doc_id").distinct().collect()} == {r.doc_id for r in stages[4].select("doc_id").collect()}


def test_run_gives_the_same_documents(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == stages[5].columns
    assert got.groupBy("doc_id").sum("length").collect().__len__() == stages[4].count()


def test_packing_follows_the_mixture_over_files_of_unequal_size(spark, tmp_path):
    from pyspark.sql import functions as F

    text = F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), (F.lit(1) + F.col("id") / 20).cast("int"))
    docs = spark.range(900).select(F.col("id").alias("doc_id"), text.alias("text"))
    docs.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "mixed"))
    packed = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).withColumn("part", F.shiftright("sequence_id", 40))
    spans = [(r.lo, r.hi) for r in packed.groupBy("part").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("part").collect()]
    assert spans[0][0] == 0 and all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == 899

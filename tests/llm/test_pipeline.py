import corpus_pipeline
from pyspark.sql import functions as F

from spanloom.llm import decontam, quality, shard, simhash
from tests.llm.conftest import sentences

SF = "/root/testdata/sf0.01"


def test_each_stage_works_on_what_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert seen[-1].columns == docs.columns
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for df in seen]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(ids[1]) == sorted(r.doc_id for r in quality.score(docs, model).where("keep").collect())
    gone = {r.doc_id for r in simhash.near_duplicates(seen[1]).collect()}
    assert sorted(ids[2]) == sorted(set(ids[1]) - gone) and gone
    leaks = {r.doc_id for r in decontam.contamination(seen[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaks) and leaks
    assert set(ids[4]) == set(ids[3]) and len(ids[4]) >= len(ids[3])
    n = len(ids[4])
    last = seen[5].orderBy("row_number").collect()
    assert [r.row_number for r in last] == list(range(n)) and [r.position for r in last] == [shard.permute(k, n) for k in range(n)]


def test_verdicts_on_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.classify(spark, docs, SF).select("doc_id", F.lit(True).alias("kept"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(kept, "doc_id", "left").withColumn("kept", F.col("kept").isNotNull())
    got = {(r.q, r.kept): r["count"] for r in labels.groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("q"), "kept").count().collect()}
    assert got[True, True] / (got[True, True] + got.get((True, False), 0)) > 0.97
    assert got[False, False] / (got[False, False] + got.get((False, True), 0)) > 0.9


def test_edges(spark, rng, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, sentences(rng, 20), None, "a", 1), (2, sentences(rng, 20), None, "a", 1), (None, sentences(rng, 9000), "en", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'mine' AS shard", "7 AS __tid0")
    for start in (docs, docs.limit(0)):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            assert k == 4 or now.columns == docs.columns
        assert now.count() >= (3 if start is docs else 0)

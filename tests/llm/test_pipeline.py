"""The pipeline against its operators one by one, and on rows that break things."""

from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontaminate, secrets

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        last, docs = docs, stage(spark, docs, DATA).cache()
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.dtypes == last.dtypes, name
    assert counts == sorted(counts, reverse=True) and counts[0] < 200 and counts[-1] == counts[-2]
    assert docs.where("not round_trip").count() == 0
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    texts = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("doc_id").isin(list(ids)))
    assert decontaminate.matches(texts, items).count() == 0
    assert secrets.scan(secrets.redact(texts)).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == ids


def test_odd_rows_pass_through(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words of a text without an id", "en", "s", 29), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # without ratings nothing is rejected
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None or isinstance(corpus_pipeline.ORACLE_SQL, str)

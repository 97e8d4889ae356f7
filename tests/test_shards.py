"""What a task takes in when an index is built, however large the segment."""

import glob

import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.operators import search
from quillon.sources import index as indexes
from quillon.sources import storage
from quillon.sources.index import Index

TEXTS = 400


@pytest.fixture
def docs(spark):
    return spark.range(TEXTS).select(F.col("id").alias("doc_id"), F.concat(F.lit("the fox "), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string"), (F.col("id") % 7).cast("string"))).alias("text"))


def pieces(spark, index, table):
    """Rows of each file of the newest segment."""
    path = f"{index.path}/{index.manifest['segments'][-1]['name']}/{table}"
    return sorted(r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect())


def test_pieces_of_a_segment_follow_its_size(spark, docs, monkeypatch):
    """Buckets had as many pieces in every segment, and several went to one task."""
    plain = Index.build(docs, storage.scratch(spark, "t"))
    monkeypatch.setattr(indexes, "SHARD_TOKENS", 200)
    monkeypatch.setattr(indexes, "DICTIONARY_SHARDS", 2)
    index = Index.build(docs, storage.scratch(spark, "t"))
    tokens = index.manifest["segments"][0]["sumdoclen"]
    own = pieces(spark, index, "postings")
    assert tokens == 5 * TEXTS and sum(own) == sum(pieces(spark, plain, "postings"))
    assert max(own) <= 200 and max(own) < max(pieces(spark, plain, "postings")) / 4  # all shards of a bucket could hold no more
    assert len(pieces(spark, index, "dictionary")) > 16 >= len(pieces(spark, plain, "dictionary"))
    for q in ("the & 3", '"fox word" & !4', "1*"):
        assert sorted(search.match(index, q).collect()) == sorted(search.match(plain, q).collect())
    assert sorted(index.dictionary().collect()) == sorted(plain.dictionary().collect())
    index = index.insert(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).delete(docs.where("doc_id < 100")).merge()[0]
    assert index.segments() == 1 and max(pieces(spark, index, "postings")) <= 200
    assert search.count(index, "the & fox").first().matches == 2 * TEXTS - 100
    index = index.reindex(docs)
    assert max(pieces(spark, index, "postings")) <= 200 and search.count(index, "the").first().matches == TEXTS


def test_long_terms_count_by_their_bytes(spark, monkeypatch):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 512))).alias("text"))
    monkeypatch.setattr(indexes, "SHARD_BYTES", 20_000)
    index = Index.build(df, storage.scratch(spark, "t"), buckets=1)
    assert len(pieces(spark, index, "postings")) > 4 and search.stats(index).first().nterms == 40


def test_files_of_a_stream_follow_its_size(spark, monkeypatch):
    """Three tasks took in all documents of the query's stream."""
    monkeypatch.setattr(queries, "_FILE_BYTES", 50_000)
    paths, scratch = {}, storage.scratch
    monkeypatch.setattr(storage, "scratch", lambda s, name: paths.setdefault(name, scratch(s, name)))
    data = "/root/testdata/sf0.001"
    got = queries.QUERIES["stream_ingest"](spark, data).collect()
    monkeypatch.setattr(storage, "scratch", scratch)
    files = glob.glob(paths["files"].removeprefix("file://") + "/*.parquet")
    assert len(files) > 3 and len(files) % 3 == 0
    assert Index.open(spark, paths["index"]).manifest["batches"] == {"documents": 2}
    assert got == queries.QUERIES["index_merge_equivalence"](spark, data).collect() and len(got) == 20

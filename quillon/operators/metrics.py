"""Relevance metrics of ranked results against judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(ranked: DataFrame, judged: DataFrame, depth: int = 10, recall_depth: int = 100) -> DataFrame:
    """(query_id, ndcg, recall, mrr) for each judged query that was run.

    ranked: (query_id, doc_id, score), judged: (query_id, doc_id, relevance). Ranks go by score and then id; documents
    without a judgement have relevance 0. Discounts are 1 / log2(rank + 1); without relevant documents all are 0.
    """
    by = Window.partitionBy("query_id")
    place = ranked.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "doc_id")))
    hits = place.join(judged.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)).cast("double"))
    gain = F.col("relevance") / F.log2(F.col("rank") + 1)
    found = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= depth, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when((F.col("rank") <= recall_depth) & (F.col("relevance") > 0), 1).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"),
    )
    ideal = judged.withColumn("relevance", F.col("relevance").cast("double")).withColumn("rank", F.row_number().over(by.orderBy(F.desc("relevance"), "doc_id")))
    best = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= depth, gain).otherwise(0.0)).alias("ideal"), F.sum(F.when(F.col("relevance") > 0, 1).otherwise(0)).alias("many"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return found.join(best, "query_id").select("query_id", ratio("dcg", "ideal").alias("ndcg"), ratio("hits", "many").alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))

"""Documents with rare terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score
from ..functions.text import column, once, tokens
from ..sources.index import Index


def _rarest(words: DataFrame, df: DataFrame, ndocs: DataFrame, k: int | None, max_df: int | None) -> DataFrame:
    """words: (doc_id, term); df: (term, df); ndocs: one row (n)."""
    if k is not None and k <= 0:
        raise ValueError("k must be greater than 0")
    most = F.lit(int(max_df)).cast("double") if max_df is not None and max_df >= 0 else F.greatest(F.floor(F.col("n") / 1000), F.lit(1)).cast("double")
    rare = df.crossJoin(F.broadcast(ndocs)).where((F.col("df") > 0) & (F.col("df") <= most))  # ndocs is one row
    rows = words.join(rare, "term").groupBy("doc_id").agg(F.min(F.struct("df", "term")).alias("r"), F.first("n").alias("n"))
    out = rows.select("doc_id", score.idf(F.col("n"), F.col("r.df")).alias("score"), F.col("r.term").alias("rarest_term"), F.col("r.df").cast("bigint").alias("min_df"))
    return out if k is None else out.orderBy(F.desc("score"), "doc_id").limit(k)


def anomalous(index: Index, k: int | None = 100, max_df: int | None = None, pending: bool = False) -> DataFrame:
    """(doc_id, score, rarest_term, min_df) of the k documents with the rarest terms, among terms of at most max_df documents.

    max_df None or negative: a thousandth of the documents, 1 at least; 0: none. Of equally rare terms the least is
    named; equal scores by id. k None: all. Documents not flushed yet are left out unless pending.
    """
    n = index.totals(pending).select(F.col("ndocs").alias("n"))
    return _rarest(index.postings(pending=pending).select("doc_id", "term"), index.dictionary(pending).select("term", "df"), n, k, max_df)


def anomalous_scan(df: DataFrame, k: int | None = 100, max_df: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same over texts without an index.

    Words are distinct within their row, so that the counts by term are sums of partial counts; rows meet only over
    the terms that are rare enough.
    """
    rows = df.select(column(df, key).alias("doc_id"), column(df, text).alias("__text")).where("__text is not null")
    n = rows.agg(F.count(F.lit(1)).cast("double").alias("n"))
    words = once(rows, F.struct(F.array_distinct(tokens(F.col("__text"))).alias("w")), F.col("doc_id")).select("doc_id", F.explode("w").alias("term"))
    return _rarest(words, words.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n, k, max_df)

"""Search without an index: one pass over the texts to match, two to rank.

Rows are matched and measured where they lie; only sums and a top k move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import score
from ..functions.text import bind, column, once, tokens
from ..plans.match import match_text, match_tokens
from ..plans.query import Query, as_query


def match(df: DataFrame, query: str | Query, text: str = "text", by_bytes: bool = False) -> DataFrame:
    """The rows of df whose text matches; null texts don't."""
    return df.where(match_text(column(df, text), query, by_bytes))


def count(df: DataFrame, query: str | Query, text: str = "text", by_bytes: bool = False) -> DataFrame:
    """(matches): how many rows match."""
    return match(df, query, text, by_bytes).agg(F.count(F.lit(1)).alias("matches"))


def features(df: DataFrame, query: str | Query, key: str = "doc_id", text: str = "text", by_bytes: bool = False) -> DataFrame:
    """(doc_id, doclen, matches, tf0, tf1, …): the length of each text, whether it matches, and how often it has each distinct literal."""
    query = as_query(query)
    terms = list(query.literals())
    rows = df.select(column(df, key).alias("doc_id"), column(df, text).alias("__text")).where("__text is not null")

    def of(toks: Column) -> Column:
        many = lambda x: F.size(F.filter(toks, lambda t: t == F.lit(x)))
        own = [many(x).alias(f"tf{i}") for i, x in enumerate(terms)]
        return F.struct(F.size(toks).alias("doclen"), match_tokens(toks, query, by_bytes).alias("matches"), *own)

    return once(rows, bind(tokens(F.col("__text")), of), F.col("doc_id"))


def scored(df: DataFrame, query: str | Query, key: str = "doc_id", text: str = "text", variant: str = "lucene", k1: float = score.K1, b: float = score.B) -> DataFrame:
    """(doc_id, score, matches, hits) of all rows with a text, by the statistics of the whole corpus; hits: distinct literals that are there."""
    query = as_query(query)
    terms = list(query.literals())
    rows = features(df, query, key, text)
    stats = rows.agg(
        F.count(F.lit(1)).cast("double").alias("ndocs"), F.avg("doclen").alias("avgdl"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).cast("double").alias(f"df{i}") for i in range(len(terms))]
    )
    place = {t: i for i, t in enumerate(terms)}
    dfs = [F.col(f"df{place[v.term]}") for v in query.values()]
    value = score.bm25_of(query, lambda t: F.col(f"tf{place[t]}"), F.col("doclen"), F.col("ndocs"), F.col("avgdl"), dfs, k1, b, variant)
    hits = sum((F.when(F.col(f"tf{i}") > 0, 1).otherwise(0) for i in range(len(terms))), F.lit(0))
    return rows.crossJoin(F.broadcast(stats)).select("doc_id", value.alias("score"), "matches", hits.alias("hits"))  # stats is one row


def search(df: DataFrame, query: str | Query, k: int = 10, key: str = "doc_id", text: str = "text", variant: str = "lucene") -> DataFrame:
    """(doc_id, score) of the k best matching rows that have a literal of the query; equal scores by id."""
    rows = scored(df, query, key, text, variant).where("matches and hits > 0").select("doc_id", "score")
    return rows.orderBy(F.desc("score"), "doc_id").limit(max(int(k), 1))

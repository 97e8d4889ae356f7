"""Search with an index: matching, counting, top k, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score
from ..plans import postings as plans
from ..plans.query import VAL, Query, as_query
from ..sources.index import Index


def search(index: Index, query: str | Query, k: int = 10, pending: bool = True, texts: DataFrame | None = None, variant: str = "lucene") -> DataFrame:
    """(doc_id, score) of the k best; a k under 1 is 1, equal scores by id. The top k is taken in each partition first.

    pending False leaves documents out that were inserted since the last flush.
    """
    return plans.ranked(index, query, pending, texts, variant).orderBy(F.desc("score"), "doc_id").limit(max(int(k), 1))


def ordered(index: Index, query: str | Query, k: int | None = None, pending: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, distance), nearest first: 1 / (1 + score). All of them without a k."""
    rows = plans.ranked(index, query, pending, texts).select("doc_id", score.distance(F.col("score")).alias("distance")).orderBy("distance", "doc_id")
    return rows if k is None else rows.limit(max(int(k), 1))


def match(index: Index, query: str | Query, pending: bool = True, texts: DataFrame | None = None, by_bytes: bool = False) -> DataFrame:
    """(doc_id) of all that match."""
    return plans.matching(index, query, pending, texts, by_bytes)


def count(index: Index, query: str | Query, pending: bool = True, texts: DataFrame | None = None, by_bytes: bool = False) -> DataFrame:
    """(matches): exact. A single term is looked up in the dictionary."""
    query = as_query(query)
    if len(query.items) == 1 and query.items[0].kind == VAL and not query.items[0].flags:
        return index.dictionary(pending, [query.items[0].term]).agg(F.coalesce(F.sum("df"), F.lit(0)).cast("bigint").alias("matches"))
    return plans.matching(index, query, pending, texts, by_bytes).agg(F.count(F.lit(1)).alias("matches"))


def stats(index: Index) -> DataFrame:
    """(ndocs, avgdl, nterms) of the live documents; nterms counts distinct terms."""
    docs = index.totals().select("ndocs", "avgdl")
    return docs.crossJoin(F.broadcast(index.dictionary().agg(F.count(F.lit(1)).alias("nterms"))))  # one row each


def document_frequencies(index: Index, query: str | Query) -> DataFrame:
    """(position, term, df) of each value of the query in order, as often as it occurs; a term without documents counts 1."""
    values = as_query(query).values()
    asked = index.spark.createDataFrame([(i, v.term) for i, v in enumerate(values)], "position int, term string")
    known = index.dictionary(terms=[v.term for v in values])
    return asked.join(known, "term", "left").select("position", "term", F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)).cast("double").alias("df"))


def segments(index: Index) -> int:
    return index.segments()

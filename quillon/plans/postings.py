"""Queries over an index as plans over its postings.

The postings of all values of a query are read once and brought together by document:
one bit for each value the document has, the sum of what its terms count, positions only
if a phrase asks for them. The query is then a predicate on a row. Patterns are looked up
in the dictionary, which is small beside the postings, and joined back to them.
Documents without any posting come in only if the query can hold without any.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import score
from ..sources.index import Index
from .match import Operand, match_text, predicate, term_matches
from .query import PHRASE, VAL, Item, Query, as_query


@dataclass
class Leaf:
    item: Item
    bit: int
    column: str | None  # of its positions


def _plan(query: Query) -> tuple[dict[tuple, Leaf], bool]:
    """A bit for each distinct value, and whether positions are needed."""
    phrases = any(i.kind == PHRASE for i in query.items)
    leaves: dict[tuple, Leaf] = {}
    for i in query.values():
        at = (i.term, i.flags, i.distance if i.flags else 0)
        if at not in leaves:
            n = len(leaves)
            if n > 62:
                raise ValueError("a query has 63 distinct terms and patterns at most")
            leaves[at] = Leaf(i, n, f"p{n}" if phrases and not i.flags else None)
    return leaves, phrases


def statistics(index: Index, terms: list[str], pending: bool = True) -> DataFrame:
    """One row: ndocs, sumdoclen, avgdl, and df0, df1, … of the terms (null without postings)."""
    docs = index.totals(pending)
    if not terms:
        return docs
    words = index.dictionary(pending, terms)
    dfs = words.agg(*[F.max(F.when(F.col("term") == F.lit(t), F.col("df"))).cast("double").alias(f"df{i}") for i, t in enumerate(terms)])
    return docs.crossJoin(F.broadcast(dfs))  # one row each


def gathered(index: Index, query: str | Query, scores: bool = False, pending: bool = True, variant: str = "lucene", k1: float = score.K1, b: float = score.B, by_bytes: bool = False) -> DataFrame:
    """(doc_id, mask, literal, score, positions of the terms of phrases) of the documents with a posting of the query.

    literal: whether a term is there as the query spells it, which ranking asks for.
    """
    query = as_query(query)
    leaves, phrases = _plan(query)
    plain = [x for x in leaves.values() if not x.item.flags]
    patterns = [x for x in leaves.values() if x.item.flags]
    counted = query.literals() if scores else {}
    terms = list(dict.fromkeys([x.item.term for x in plain] + list(counted)))
    rows = index.postings(terms, pending)
    bit = reduce(lambda c, x: c.when(F.col("term") == F.lit(x.item.term), F.lit(1 << x.bit)), plain, F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    value = F.lit(0.0)
    if scores:
        rows = rows.crossJoin(F.broadcast(statistics(index, list(counted), pending)))  # one row
        value = reduce(lambda c, x: c.when(F.col("term") == F.lit(x[1][0]), x[1][1] * score.idf(F.col("ndocs"), F.col(f"df{x[0]}"), variant)), enumerate(counted.items()), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))
        value = value * score.saturation(F.col("tf"), F.col("doclen"), F.col("avgdl"), k1, b, variant)
    where = [F.when(F.col("term") == F.lit(x.item.term), F.col("positions")).alias(x.column) for x in plain if x.column]
    parts = rows.select("doc_id", bit.alias("mask"), F.lit(True).alias("literal"), value.alias("score"), *where)
    for x in patterns:
        words = index.dictionary(pending, bucket=True).where(term_matches(F.col("term"), x.item, by_bytes)).select("bucket", "term")
        hits = index.postings(None, pending, bucket=True).join(words, ["bucket", "term"], "left_semi")
        parts = parts.unionAll(hits.select("doc_id", F.lit(1 << x.bit).cast("bigint").alias("mask"), F.lit(False).alias("literal"), F.lit(0.0).alias("score"), *[F.lit(None).cast("array<int>").alias(y.column) for y in plain if y.column]))
    return parts.groupBy("doc_id").agg(F.bit_or("mask").alias("mask"), F.max("literal").alias("literal"), F.sum("score").alias("score"), *[F.max(y.column).alias(y.column) for y in plain if y.column])


def gate(index: Index, query: Query) -> Column:
    """The query as a predicate on the rows of gathered()."""
    leaves, _ = _plan(query)
    positions = index.manifest["positions"]

    def leaf(i: Item) -> Operand:
        x = leaves[(i.term, i.flags, i.distance if i.flags else 0)]
        return Operand(F.col("mask").bitwiseAND(F.lit(1 << x.bit)) != 0, F.coalesce(x.column, F.array().cast("array<int>")) if x.column and positions else None)

    return predicate(query, leaf)


def can_hold_alone(query: Query) -> bool:
    """Whether a document without any of the values matches."""
    return bool(query.items) and query.holds(lambda i: False)


def matching(index: Index, query: str | Query, pending: bool = True, texts: DataFrame | None = None, by_bytes: bool = False) -> DataFrame:
    """(doc_id) of the documents that match. An index without positions needs the texts (doc_id, text) for phrases, to look again."""
    query = as_query(query)
    if not query.items:
        return index.documents(pending).select("doc_id").where("false")
    again = any(i.kind == PHRASE for i in query.items) and not index.manifest["positions"]
    if again and texts is None:
        raise ValueError("the index has no positions: give the texts to verify phrases against")
    if again:  # candidates: all that may match, whatever phrases and negations say
        found = (index.documents(pending) if can_hold_alone(query) else gathered(index, query, pending=pending, by_bytes=by_bytes)).select("doc_id")
        return texts.join(found, "doc_id", "left_semi").where(match_text(F.col("text"), query, by_bytes)).select("doc_id")
    rows = gathered(index, query, pending=pending, by_bytes=by_bytes)
    if can_hold_alone(query):
        rows = index.documents(pending).select("doc_id").join(rows, "doc_id", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("bigint")))
    return rows.where(gate(index, query)).select("doc_id")


def ranked(index: Index, query: str | Query, pending: bool = True, texts: DataFrame | None = None, variant: str = "lucene", k1: float = score.K1, b: float = score.B, by_bytes: bool = False) -> DataFrame:
    """(doc_id, score) of the documents that match and have a term as the query spells it."""
    query = as_query(query)
    if not query.items:
        return index.documents(pending).select("doc_id", F.lit(0.0).alias("score")).where("false")
    rows = gathered(index, query, True, pending, variant, k1, b, by_bytes).where("literal")
    if any(i.kind == PHRASE for i in query.items) and not index.manifest["positions"]:
        return rows.join(matching(index, query, pending, texts, by_bytes), "doc_id", "left_semi").select("doc_id", "score")
    if any(i.kind not in (VAL, "or") or i.flags for i in query.items):  # terms joined by OR need no gate
        rows = rows.where(gate(index, query))
    return rows.select("doc_id", "score")

"""Relevance: the BM25 family over term frequencies, as arithmetic on columns.

A score is the sum over the values of the query, each as often as it occurs, negated
ones and patterns (by their literal text) too; the Boolean structure has no part in it.
Document frequencies that are missing or null are 1; a required argument that is null
makes the score null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import Query, as_query
from .text import term_frequency

K1, B, DELTA_PLUS, DELTA_L = 1.2, 0.75, 1.0, 0.5
VARIANTS = {"lucene": "lucene", "robertson": "robertson", "atire": "atire", "bm25+": "bm25+", "bm25plus": "bm25+", "bm25l": "bm25l", "l": "bm25l"}
Number = float | int | Column


def _column(x: Number | None) -> Column:
    return x if isinstance(x, Column) else F.lit(None if x is None else float(x)).cast("double")


def variant_name(variant: str) -> str:
    if variant not in VARIANTS:
        raise ValueError(f'unknown bm25 variant "{variant}"; valid variants: lucene, robertson, atire, bm25+, bm25l')
    return VARIANTS[variant]


def idf(n: Number, df: Number | None, variant: str = "lucene") -> Column:
    """Inverse document frequency; df is held between 1 and n."""
    n = F.greatest(_column(n), F.lit(1.0))
    df = F.least(F.greatest(F.coalesce(_column(df), F.lit(1.0)), F.lit(1.0)), n)
    rare = (n - df + 0.5) / (df + 0.5)
    name = variant_name(variant)
    return F.log(rare) if name == "robertson" else F.log(n / df) if name == "atire" else F.log((n + 1) / (df + 0.5)) if name == "bm25l" else F.log(1 + rare)


def saturation(tf: Column, doclen: Column, avgdl: Number, k1: Number = K1, b: Number = B, variant: str = "lucene") -> Column:
    """What a term's frequency counts, 0 where it is 0."""
    avgdl, k1, b, name = _column(avgdl), _column(k1), _column(b), variant_name(variant)
    avgdl = F.when(avgdl <= 0, 1.0).otherwise(avgdl)
    tf = tf.cast("double")
    length = 1 - b + b * doclen / avgdl
    if name == "bm25l":
        held = tf / length
        part = (k1 + 1) * (held + DELTA_L) / (k1 + held + DELTA_L)
    else:
        part = tf * (k1 + 1) / (tf + k1 * length)
        if name == "bm25+":
            part = part + DELTA_PLUS
    return F.when(tf > 0, part).otherwise(F.lit(0.0))


def bm25_of(query: str | Query, tf: Callable[[str], Column], doclen: Column, n: Number, avgdl: Number, dfs: Sequence[Number | None] | Column | None = None, k1: Number = K1, b: Number = B, variant: str = "lucene") -> Column:
    """The score from a function that gives the frequency of a term. dfs: for each value of the query, in order."""
    total = F.lit(0.0)
    for i, item in enumerate(as_query(query).values()):
        df = None if dfs is None else F.get(dfs, F.lit(i)) if isinstance(dfs, Column) else dfs[i] if i < len(dfs) else None
        total = total + idf(n, df, variant) * saturation(tf(item.term), doclen, avgdl, k1, b, variant)
    required = _column(n).isNotNull() & _column(avgdl).isNotNull() & _column(k1).isNotNull() & _column(b).isNotNull() & doclen.isNotNull()
    return F.when(required, total)


def bm25(doc: Column, query: str | Query, n: Number, avgdl: Number, dfs: Sequence[Number | None] | Column | None = None, k1: Number = K1, b: Number = B, variant: str = "lucene") -> Column:
    """The score of an analyzed document."""
    return bm25_of(query, lambda t: term_frequency(doc, t), doc["doclen"], n, avgdl, dfs, k1, b, variant)


def bm25f(docs: Sequence[Column], query: str | Query, weights: Sequence[Number | None], n: Number, avgdls: Sequence[Number | None], dfs: Sequence[Number | None] | None = None) -> Column:
    """Several fields: frequencies are weighted and normalised by field, then saturated together. A null field is left out."""
    if not len(docs) == len(weights) == len(avgdls):
        raise ValueError("as many weights and average lengths as documents are needed")
    total = F.lit(0.0)
    for i, item in enumerate(as_query(query).values()):
        tf = F.lit(0.0)
        for doc, weight, avgdl in zip(docs, weights, avgdls, strict=True):
            mean = F.coalesce(_column(avgdl), F.lit(1.0))
            length = 1 - B + B * doc["doclen"] / F.when(mean <= 0, 1.0).otherwise(mean)
            tf = tf + F.coalesce(F.coalesce(_column(weight), F.lit(1.0)) * term_frequency(doc, item.term) / length, F.lit(0.0))
        df = dfs[i] if dfs is not None and i < len(dfs) else None
        total = total + F.when(tf > 0, idf(n, df) * tf * (K1 + 1) / (K1 + tf)).otherwise(F.lit(0.0))
    return F.when(_column(n).isNotNull(), total)


def distance(score: Column) -> Column:
    return 1 / (1 + score)


def distance_fallback(doc: Column, query: str | Query) -> Column:
    """The distance without statistics of a corpus: one document, of its own average length."""
    return distance(bm25(doc, query, 1.0, doc["doclen"]))

"""The functions under their SQL names.

Queries are constants, so SQL functions that take one get it as text and are planned when
the function is called from Python; in SQL itself they are Arrow functions that parse each
distinct query once. For plans that stay in the JVM use the column functions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.query import _WORD, FUZZY, PREFIX, REGEX, Query, fold
from . import batches, codec, english, score
from .text import DOC_TYPE


@lru_cache(maxsize=1024)
def _query(text: str) -> Query:
    return Query.parse(text)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@lru_cache(maxsize=1024)
def _pattern(text: str) -> re.Pattern:
    return re.compile(python_regex(text))


def python_regex(pattern: str) -> str:
    """A pattern of the advanced dialect in Python's: word constraints and classes differ."""
    classes = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9a-fA-F"}
    words = {"m": r"\b(?=\w)", "<": r"\b(?=\w)", "M": r"\b(?<=\w)", ">": r"\b(?<=\w)", "y": r"\b", "Y": r"\B"}

    def one(m: re.Match) -> str:
        if m[3]:
            return classes[m[3]]
        return words.get(m[1] or m[2], m[0])

    return re.sub(r"\\(.)|\[\[:([<>]):\]\]|\[:(alpha|digit|alnum|upper|lower|space|punct|xdigit):\]", one, pattern, flags=re.S)


def matches(doc: dict, query: Query) -> bool:
    """A document against a query, one at a time: the model that the plans are tested against."""
    known = {t["term"]: t for t in doc["terms"]}
    step = lambda left, right, d: [p for p in right if any(0 < p - x <= d for x in left)]

    def value(i):
        if i.flags & REGEX:
            return any(_pattern(i.term).search(t) for t in known), None
        if i.flags & FUZZY:
            return any(abs(len(t) - len(i.term)) <= i.distance and _edits(t, i.term) <= i.distance for t in known), None
        if i.flags & PREFIX:
            return any(t.startswith(i.term) for t in known), None
        return i.term in known, (list(known[i.term]["pos"]) if i.term in known else []) if doc["has_pos"] else None

    def phrase(a, b, d):
        if a[1] is None or b[1] is None:
            return a[0] and b[0], None
        where = step(a[1], b[1], d)
        return bool(where), where

    out = query.fold(value, lambda a: (not a[0], None), lambda a, b: (a[0] and b[0], None), lambda a, b: (a[0] or b[0], None), phrase)
    return bool(out and out[0])


def unpacked(docs: pa.Array, wanted: set[str] | None = None) -> list[dict | None]:
    """Documents of Arrow as Python's; with the wanted terms alone, if there is such a set."""
    lists, doclen, has_pos = docs.flatten()
    owner = np.repeat(np.arange(len(docs)), pc.fill_null(lists.value_lengths(), 0).to_numpy())
    entries = lists.flatten()
    if wanted is not None:
        there = pc.is_in(entries.field("term"), pa.array(sorted(wanted), pa.string()))
        entries, owner = entries.filter(there), owner[there.to_numpy(False)]
    term, tf, pos = entries.flatten()
    rows = [{"term": t, "tf": f, "pos": p} for t, f, p in zip(term.to_pylist(), tf.to_pylist(), _lists(pos), strict=True)]
    to = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
    known = zip(docs.is_valid().to_pylist(), doclen.to_pylist(), has_pos.to_pylist(), strict=True)
    return [{"terms": rows[to[i] : to[i + 1]], "doclen": n, "has_pos": bool(p)} if there else None for i, (there, n, p) in enumerate(known)]


def _lists(values: pa.Array) -> list[list | None]:
    flat, ends = values.flatten().to_pylist(), np.cumsum(pc.fill_null(values.value_lengths(), 0).to_numpy()).tolist()
    return [flat[a:b] if there else None for a, b, there in zip([0, *ends], ends, values.is_valid().to_pylist(), strict=False)]


def _idf(n: float, dfs, i: int, variant: str = "lucene") -> float:
    df = dfs[i] if dfs is not None and i < len(dfs) and dfs[i] is not None else 1.0
    n = max(n, 1.0)
    df = min(max(df, 1.0), n)
    rare = (n - df + 0.5) / (df + 0.5)
    return {"robertson": lambda: math.log(rare), "atire": lambda: math.log(n / df), "bm25l": lambda: math.log((n + 1) / (df + 0.5))}.get(variant, lambda: math.log(1 + rare))()


def bm25(doc: dict, query: Query, n: float, avgdl: float, dfs=None, k1: float = score.K1, b: float = score.B, variant: str = "lucene") -> float:
    tf = {t["term"]: t["tf"] for t in doc["terms"]}
    avgdl, total, name = avgdl if avgdl > 0 else 1.0, 0.0, score.variant_name(variant)
    length = 1 - b + b * doc["doclen"] / avgdl
    for i, v in enumerate(query.values()):
        f = tf.get(v.term, 0)
        if f:
            held = f / length + score.DELTA_L
            part = (k1 + 1) * held / (k1 + held) if name == "bm25l" else f * (k1 + 1) / (f + k1 * length) + (score.DELTA_PLUS if name == "bm25+" else 0.0)
            total += _idf(n, dfs, i, name) * part
    return total


def bm25f(fields: list[dict | None], query: Query, weights, n: float, avgdls, dfs=None) -> float:
    if not len(fields) == len(weights) == len(avgdls):
        raise ValueError("as many weights and average lengths as documents are needed")
    total = 0.0
    for i, v in enumerate(query.values()):
        tf = 0.0
        for doc, weight, avgdl in zip(fields, weights, avgdls, strict=True):
            if doc is not None:
                mean = 1.0 if avgdl is None or avgdl <= 0 else avgdl
                tf += (1.0 if weight is None else weight) * next((t["tf"] for t in doc["terms"] if t["term"] == v.term), 0) / (1 - score.B + score.B * doc["doclen"] / mean)
        if tf > 0:
            total += _idf(n, dfs, i) * tf * (score.K1 + 1) / (score.K1 + tf)
    return total


def snippet(text: str, query: Query, before: str, after: str, ellipsis: str, size: int) -> str:
    """The window of size tokens with most hits, the earliest of equals."""
    words, terms, size = _WORD.findall(text), query.literals(), max(size, 1)
    hit = [fold(w) in terms for w in words]
    best = now = sum(hit[:size])
    start = 0
    for i in range(size, len(words)):
        now += hit[i] - hit[i - size]
        if now > best:
            best, start = now, i - size + 1
    shown = " ".join(before + w + after if h else w for w, h in zip(words[start : start + size], hit[start : start + size], strict=True))
    return (ellipsis if start else "") + shown + (ellipsis if start + size < len(words) else "")


def register(spark: SparkSession) -> None:
    """In SQL: to_ftsdoc, to_ftsdoc_config, ftsdoc (the cast of a literal), to_ftsquery, tsquery_to_ftsquery, ftsdoc_length,
    fts_match, fts_bm25, fts_bm25_dfs, fts_bm25_opts, fts_bm25f, fts_distance, fts_highlight, fts_snippet."""

    def answers(kind: pa.DataType, of: Callable, *columns: pa.Array, wanted: Callable[[Query], set[str] | None] | None = None) -> pa.Array:
        """of the values of each row, null if one of its first two (the document or text, and the query) is null; documents have the terms wanted by the queries of a slice."""

        def part(*own: pa.Array) -> pa.Array:
            rows = [c.to_pylist() for c in own[1:]]
            if wanted is None:
                first = own[0].to_pylist()
            else:
                there = own[0].is_valid().to_pylist()
                sets = [wanted(_query(q)) for q in dict.fromkeys(q for q, t in zip(rows[0], there, strict=True) if t and q is not None)]
                first = unpacked(own[0], None if any(x is None for x in sets) else set().union(*sets))
            return pa.array([None if x[0] is None or x[1] is None else of(*x) for x in zip(first, *rows, strict=True)], kind)

        return batches.in_slices(part, kind, *columns)

    def documents(of: Callable, *columns: pa.Array) -> pa.Array:
        """The documents that of makes of rows without nulls."""
        part = lambda *own: pa.array([None if None in x else of(*x) for x in zip(*[c.to_pylist() for c in own], strict=True)], batches.DOC)
        return batches.in_slices(part, batches.DOC, *columns)

    def texts_of(of: Callable, texts: pa.Array) -> pa.Array:
        return batches.in_slices(lambda own: pa.array([None if t is None else of(t) for t in own.to_pylist()], pa.string()), pa.string(), texts)

    absent = lambda *values: any(v is None or v != v for v in values)  # noqa: E731  # null or not a number
    terms = lambda query: {v.term for v in query.values()}
    unless_patterns = lambda query: None if any(v.flags for v in query.values()) else terms(query)

    @F.arrow_udf(DOC_TYPE)
    def to_ftsdoc(texts: pa.Array) -> pa.Array:
        def part(own: pa.Array) -> pa.Array:
            folded = pa.array([None if t is None else fold(t) for t in own.to_pylist()], pa.string())
            return batches.documents(*batches.cut(folded), own.is_null().to_numpy(False))

        return batches.in_slices(part, batches.DOC, texts)

    @F.arrow_udf(DOC_TYPE)
    def to_ftsdoc_config(configs: pa.Array, texts: pa.Array) -> pa.Array:
        return documents(english.document, texts, configs)

    @F.arrow_udf(DOC_TYPE)
    def ftsdoc(literals: pa.Array) -> pa.Array:
        return documents(codec.parse, literals)

    @F.arrow_udf("string")
    def to_ftsquery(texts: pa.Array) -> pa.Array:
        return texts_of(lambda t: str(_query(t)), texts)

    @F.arrow_udf("string")
    def tsquery_to_ftsquery(texts: pa.Array) -> pa.Array:
        return texts_of(lambda t: str(Query.from_tsquery(t)), texts)

    @F.arrow_udf("int")
    def ftsdoc_length(docs: pa.Array) -> pa.Array:
        return docs.flatten()[1]

    @F.arrow_udf("boolean")
    def fts_match(docs: pa.Array, queries: pa.Array) -> pa.Array:
        return answers(pa.bool_(), lambda d, q: matches(d, _query(q)), docs, queries, wanted=unless_patterns)

    @F.arrow_udf("double")
    def fts_bm25(docs: pa.Array, queries: pa.Array, n: pa.Array, avgdl: pa.Array) -> pa.Array:
        return answers(pa.float64(), lambda d, q, x, y: None if absent(x, y) else bm25(d, _query(q), x, y), docs, queries, n, avgdl, wanted=terms)

    @F.arrow_udf("double")
    def fts_bm25_dfs(docs: pa.Array, queries: pa.Array, n: pa.Array, avgdl: pa.Array, dfs: pa.Array) -> pa.Array:
        return answers(pa.float64(), lambda d, q, x, y, f: None if absent(x, y) else bm25(d, _query(q), x, y, f), docs, queries, n, avgdl, dfs, wanted=terms)

    @F.arrow_udf("double")
    def fts_bm25_opts(docs: pa.Array, queries: pa.Array, n: pa.Array, avgdl: pa.Array, dfs: pa.Array, k1: pa.Array, b: pa.Array, variant: pa.Array) -> pa.Array:
        one = lambda d, q, x, y, f, k, c, v: None if v is None or absent(x, y, k, c) else bm25(d, _query(q), x, y, f, k, c, v)
        return answers(pa.float64(), one, docs, queries, n, avgdl, dfs, k1, b, variant, wanted=terms)

    @F.arrow_udf("double")
    def fts_bm25f(fields: pa.Array, queries: pa.Array, weights: pa.Array, n: pa.Array, avgdls: pa.Array, dfs: pa.Array) -> pa.Array:
        one = lambda f, q, w, x, a, d: None if w is None or a is None or absent(x) else bm25f(f, _query(q), w, x, a, d)
        return answers(pa.float64(), one, fields, queries, weights, n, avgdls, dfs)

    @F.arrow_udf("double")
    def fts_distance(docs: pa.Array, queries: pa.Array) -> pa.Array:
        return answers(pa.float64(), lambda d, q: 1 / (1 + bm25(d, _query(q), 1.0, d["doclen"])), docs, queries, wanted=terms)

    @F.arrow_udf("string")
    def fts_snippet(texts: pa.Array, queries: pa.Array, before: pa.Array, after: pa.Array, ellipsis: pa.Array, size: pa.Array) -> pa.Array:
        return answers(pa.string(), lambda t, q, a, b, e, k: snippet(t, _query(q), a, b, e, int(k)), texts, queries, before, after, ellipsis, size)

    def parts(text: str) -> list[str]:
        return re.findall("[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff]+", text)

    @F.arrow_udf("string")
    def fts_highlight(texts: pa.Array, queries: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        return answers(pa.string(), lambda t, q, a, b: "".join(a + x + b if fold(x) in _query(q).literals() else x for x in parts(t)), texts, queries, before, after)

    for f in (to_ftsdoc, to_ftsdoc_config, ftsdoc, to_ftsquery, tsquery_to_ftsquery, ftsdoc_length, fts_match, fts_bm25, fts_bm25_dfs, fts_bm25_opts, fts_bm25f, fts_distance, fts_highlight, fts_snippet):
        spark.udf.register(f.__name__, f)

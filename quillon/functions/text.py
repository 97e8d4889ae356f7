"""Analysis of text: folding, tokens, documents of sorted distinct terms.

A token is a run of ASCII letters, digits and characters from U+0080 on, folded by the
simple lower-case mapping of each character. Positions count from 1. A document is a
struct of its distinct terms in byte order with their frequencies and positions, and
its length in tokens. A null text gives a null document, one without tokens an empty one.

analyze() makes documents of whole columns, from Arrow batches (batches.py); document() is
the same as an expression, for a text inside another one. A document is made within its
row, in n log n steps for n tokens, so analysis never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches

TOKEN = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
DOC_TYPE = "struct<terms: array<struct<term: string, tf: int, pos: array<int>>>, doclen: int, has_pos: boolean>"


def column(df: DataFrame, name: str) -> Column:
    """The column of that very name; dots in it are no path."""
    return df["`" + name.replace("`", "``") + "`"]


def fold(text: Column) -> Column:
    """Lower case by single characters: full case mapping differs for two letters, which are replaced first."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def tokens(text: Column) -> Column:
    """Folded tokens in order. Folding keeps word characters word characters, so that the whole text is folded at once."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is made once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, made: Column, *kept: Column) -> DataFrame:
    """The kept columns and the fields of a struct, as the output of a generator: no filter is pushed below it to make the struct again."""
    return df.select(*kept, F.inline(F.array(made)))


def document(text: Column) -> Column:
    """The analyzed document of a text: tokens are sorted with their positions, and runs of equal terms become the entries."""
    placed = F.array_sort(F.transform(tokens(text), lambda t, i: F.struct(t.alias("term"), (i + 1).alias("pos"))))

    def of(s: Column) -> Column:
        at = lambda i: F.get(s, i)["term"]
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (at(i - 1) != x["term"]), i)), lambda i: i.isNotNull())

        def entries(k: Column) -> Column:
            size = lambda i, j: F.coalesce(F.get(k, j + 1), F.size(s)) - i
            return F.transform(k, lambda i, j: F.struct(at(i).alias("term"), size(i, j).alias("tf"), F.transform(F.slice(s, i + 1, size(i, j)), lambda x: x["pos"]).alias("pos")))

        made = F.struct(bind(starts, entries).alias("terms"), F.size(s).alias("doclen"), F.lit(True).alias("has_pos"))
        return F.when(s.isNotNull(), made)

    return bind(placed, of)


def analyze(df: DataFrame, text: str = "text", doc: str = "doc", keep_text: bool = True) -> DataFrame:
    """df with the analyzed document of a text column; a column of that name is replaced. keep_text: whether the text itself stays."""
    kept = [column(df, c) for c in df.columns if c.lower() != doc.lower() and (keep_text or c != text)]
    return batches.with_documents(df.select(*kept, fold(column(df, text)).alias("__text")), doc)


def doc_length(doc: Column) -> Column:
    return doc["doclen"]


def entry(doc: Column, term: str) -> Column:
    """The entry of a term, null if the document hasn't it."""
    return F.get(F.filter(doc["terms"], lambda t: t["term"] == F.lit(term)), F.lit(0))


def term_frequency(doc: Column, term: str) -> Column:
    return F.coalesce(entry(doc, term)["tf"], F.lit(0))


def canonical(doc: Column) -> Column:
    """'term':tf@p,q … in byte order; quotes and backslashes escaped."""

    def one(t: Column) -> Column:
        name = F.concat(F.lit("'"), F.regexp_replace(t["term"], r"(['\\])", r"\\$1"), F.lit("':"), t["tf"].cast("string"))
        where = F.array_join(F.transform(t["pos"], lambda p: p.cast("string")), ",")
        return F.when(doc["has_pos"], F.concat(name, F.lit("@"), where)).otherwise(name)

    return F.array_join(F.transform(doc["terms"], one), " ")


def valid(doc: Column) -> Column:
    """Whether a struct that came from elsewhere is a document: distinct sorted terms, frequencies of 1 or more, as many ascending positions."""
    terms = doc["terms"]
    names = F.transform(terms, lambda t: t["term"])
    ascending = lambda p: p == F.array_sort(F.array_distinct(p))
    each = F.forall(terms, lambda t: t["term"].isNotNull() & (t["tf"] >= 1) & F.when(doc["has_pos"], (F.size(t["pos"]) == t["tf"]) & ascending(t["pos"])).otherwise(F.lit(True)))
    return F.coalesce(each & ascending(names) & (doc["doclen"] >= 0), F.lit(False))

"""Highlighted texts and snippets.

A token is marked if its fold is the text of any value of the query, negated values and
patterns (literally) included; nothing is stemmed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import Query, as_query
from .text import TOKEN, bind, fold

_PARTS = TOKEN + r"|[^A-Za-z0-9\x{80}-\x{10FFFF}]+"
_FIRST = r"^[A-Za-z0-9\x{80}-\x{10FFFF}]"


def _hit(token: Column, query: str | Query) -> Column:
    terms = list(as_query(query).literals())
    return fold(token).isin(terms) if terms else F.lit(False)


def highlight(text: Column, query: str | Query, before: str = "<b>", after: str = "</b>") -> Column:
    """The text with its hits marked and all else as it is; null for null."""
    parts = F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(_hit(x, query), F.concat(F.lit(before), x, F.lit(after))).otherwise(x)), "")


def snippet(text: Column, query: str | Query, before: str = "<b>", after: str = "</b>", ellipsis: str = "...", max_tokens: int = 15) -> Column:
    """The tokens of the window of max_tokens with most hits (the earliest of equals), joined by blanks; '' without tokens.

    Of the best windows the earliest begins the text or ends with a hit, so one window for each hit is counted, over
    the hits just before it.
    """
    size = max(int(max_tokens), 1)
    plain = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def of(toks: Column) -> Column:
        hits = F.filter(F.transform(toks, lambda t, i: F.when(_hit(t, query), i)), lambda i: i.isNotNull())

        def best(where: Column) -> Column:
            first = F.struct(F.size(F.filter(F.slice(where, 1, size), lambda h: h < size)).alias("hits"), F.lit(0).alias("back"))
            ending = F.transform(where, lambda h, j: F.struct(F.size(F.filter(F.slice(where, F.greatest(j - size + 2, F.lit(1)), F.least(j + 1, F.lit(size))), lambda x: x > h - size)).alias("hits"), F.least(size - 1 - h, F.lit(0)).alias("back")))
            counted = F.concat(F.array(first), ending)
            start = -F.array_max(counted)["back"]

            def shown(s: Column) -> Column:
                marked = F.transform(F.slice(toks, s + 1, size), lambda t: F.when(_hit(t, query), F.concat(F.lit(before), t, F.lit(after))).otherwise(t))
                lead = F.when(s > 0, F.lit(ellipsis)).otherwise("")
                tail = F.when(s + size < F.size(toks), F.lit(ellipsis)).otherwise("")
                return F.concat(lead, F.array_join(marked, " "), tail)

            return bind(start, shown)

        return bind(hits, best)

    return bind(plain, of)

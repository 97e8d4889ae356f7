"""Queries as predicates: over token arrays, over analyzed documents.

A predicate is an ordinary Boolean column, never null but for a null text or document;
it runs where the row is. The empty query is false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind, tokens
from .query import FUZZY, PREFIX, REGEX, Item, Query, as_query

#: Gaps of phrase steps up to which the positions in reach are spelled out and intersected.
_SPELLED = 16


def java_regex(pattern: str) -> str:
    """A pattern of the advanced dialect in Java's: the word constraints differ."""
    out, at = [], 0
    for m in re.finditer(r"\\(.)|\[\[:([<>]):\]\]", pattern, re.S):
        out.append(pattern[at : m.start()])
        word = {"m": r"\b(?=\w)", "<": r"\b(?=\w)", "M": r"\b(?<=\w)", ">": r"\b(?<=\w)", "y": r"\b", "Y": r"\B"}.get(m[1] or m[2])
        out.append(word if word else m[0])
        at = m.end()
    text = "".join(out) + pattern[at:]
    return re.sub(r"\[:(alpha|digit|alnum|upper|lower|space|punct|xdigit):\]", lambda m: r"\p{" + {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}[m[1]] + "}", text)


def bytewise(text: Column) -> Column:
    """A string with one character for each byte of UTF-8."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def term_matches(term: Column, item: Item, by_bytes: bool = False) -> Column:
    """Whether a term is one that an item of the query stands for. by_bytes: edits of fuzzy terms are counted in bytes."""
    if item.flags & REGEX:
        return F.rlike(term, F.lit(java_regex(item.term)))
    if item.flags & FUZZY:
        a, b = (bytewise(term), F.lit(item.term.encode().decode("latin-1"))) if by_bytes else (term, F.lit(item.term))
        return (F.abs(F.length(a) - F.length(b)) <= item.distance) & (F.levenshtein(a, b, item.distance) >= 0)
    return term.startswith(item.term) if item.flags & PREFIX else term == F.lit(item.term)


def phrase_step(left: Column, right: Column, distance: int) -> Column:
    """The positions of right that follow one of left by at most distance; both are ascending."""
    if distance == 1:
        return F.array_intersect(right, F.transform(left, lambda x: x + 1))
    if distance <= _SPELLED:
        return F.array_intersect(right, F.flatten(F.transform(left, lambda x: F.sequence(x + 1, x + distance))))
    # the nearest one before decides
    return F.filter(right, lambda p: F.coalesce(p - F.array_max(F.filter(left, lambda x: x < p)) <= distance, F.lit(False)))


@dataclass
class Operand:
    """Whether a part of the query holds, and where; positions None: nowhere in particular."""

    present: Column
    positions: Column | None = None


class Leaves(Protocol):
    """How a plan knows a value of the query."""

    def __call__(self, item: Item) -> Operand: ...


def predicate(query: Query, leaf: Leaves, has_positions: Column | None = None) -> Column:
    """The query over the operands of its values. has_positions: where it is false, phrases are AND."""

    def phrase(a: Operand, b: Operand, distance: int) -> Operand:
        both = a.present & b.present
        if a.positions is None or b.positions is None:
            return Operand(both)
        where = phrase_step(a.positions, b.positions, distance)
        found = both & (F.size(where) > 0)
        if has_positions is None:
            return Operand(found, where)
        return Operand(F.when(has_positions, found).otherwise(both), where)

    out = query.fold(leaf, lambda x: Operand(~x.present), lambda a, b: Operand(a.present & b.present), lambda a, b: Operand(a.present | b.present), phrase)
    return out.present if out else F.lit(False)


def match_tokens(toks: Column, query: str | Query, by_bytes: bool = False) -> Column:
    """Whether a text matches, from its array of tokens (a bound one: each value of the query reads it)."""

    def leaf(item: Item) -> Operand:
        if item.flags:
            return Operand(F.exists(toks, lambda t: term_matches(t, item, by_bytes)))
        where = F.filter(F.transform(toks, lambda t, i: F.when(t == F.lit(item.term), i + 1)), lambda i: i.isNotNull())
        return Operand(F.array_contains(toks, item.term), where)

    query = as_query(query)
    return F.when(toks.isNotNull(), predicate(query, leaf)) if query.items else F.when(toks.isNotNull(), F.lit(False))


def match_text(text: Column, query: str | Query, by_bytes: bool = False) -> Column:
    """Whether a text matches; it is cut into tokens once."""
    return bind(tokens(text), lambda t: match_tokens(t, query, by_bytes))


def match_doc(doc: Column, query: str | Query, by_bytes: bool = False) -> Column:
    """Whether an analyzed document matches."""

    def leaf(item: Item) -> Operand:
        if item.flags:
            return Operand(F.exists(doc["terms"], lambda t: term_matches(t["term"], item, by_bytes)))
        own = F.filter(doc["terms"], lambda t: t["term"] == F.lit(item.term))
        return Operand(F.size(own) > 0, F.coalesce(F.get(own, F.lit(0))["pos"], F.array().cast("array<int>")))

    query = as_query(query)
    return F.when(doc.isNotNull(), predicate(query, leaf, doc["has_pos"]))

"""Analyzers by configuration: simple (words as they are) and english (stop words go, words are stemmed).

The parser cuts words, numbers and compound words with hyphens (the compound and its
parts are words of their own, at positions of their own); stop words keep their position
and count in the length. The stemmer follows the published Porter2 algorithm; Spark has
none, so that this analyzer is an Arrow function over batches of texts, in which each
distinct word is folded and stemmed once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.query import Query, fold
from . import batches
from .text import column

STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a
    an the and but if or because as until while of at by for with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor
    not only own same so than too very s t can will just don should now""".split()
)

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in _V and word[i - 1] in _V:
            return i + 1
    return len(word)


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _V and word[1] not in _V
    return len(word) > 2 and word[-1] not in _V + "wxY" and word[-2] in _V and word[-3] not in _V


@lru_cache(maxsize=1 << 15)
def stem(word: str) -> str:
    """The Porter2 stem of a word in lower case; words with other than a-z and apostrophes stay."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _SAME:
        return word
    w = word.removeprefix("'")
    w = re.sub(f"(^|[{_V}])y", r"\1Y", w)
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), "")
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1) if r1 < len(w) else len(w)

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), "")
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(f"[{_V}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(end)] + to
            break
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    end = next((e for e in _STEP4 if w.endswith(e)), "")
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: New words after which a task forgets those that it met longest ago.
_KEPT = 1 << 16
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)+|[^\W_]+")


def lexemes(text: str, config: str) -> list[str | None]:
    """What each position of a text holds; None for a stop word."""
    out: list[str | None] = []
    for m in _WORD.finditer(text):
        word = fold(m[0])
        for part in [word, *word.split("-")] if "-" in word else [word]:
            out.append(part if config == "simple" else None if part in STOP else stem(part))
    return out


def document(text: str, config: str) -> dict:
    """The document of one text."""
    normalize(config)
    found = lexemes(text, config)
    where: dict[str, list[int]] = {}
    for i, x in enumerate(found):
        if x:
            where.setdefault(x, []).append(i + 1)
    return {"terms": [{"term": x, "tf": len(p), "pos": p} for x, p in sorted(where.items(), key=lambda e: e[0].encode())], "doclen": len(found), "has_pos": True}


def normalize(config: str):
    """For Query.parse: the first lexeme of a term, None for a stop word."""
    if config not in ("simple", "english"):
        raise ValueError(f'text search configuration "{config}" does not exist')
    return lambda term: next((x for x in lexemes(term, config) if x), None)


def parse_query(config: str, text: str) -> Query:
    return Query.parse(text, normalize(config))


class _Recent:
    """The terms of the words that a task met lately: of two generations, so that common words stay, whatever the number of words."""

    def __init__(self, config: str):
        self.config, self.new, self.old = config, {}, {}

    def age(self) -> None:
        """To be called between slices."""
        if len(self.new) > _KEPT:
            self.new, self.old = {}, self.new

    def terms(self, word: str) -> tuple[str | None, ...]:
        own = self.new.get(word)
        if own is None:
            own = self.new[word] = self.old.get(word) or tuple(lexemes(word, self.config))
        return own


def analyze_config(df: DataFrame, config: str, text: str = "text", doc: str = "doc", keep_text: bool = True) -> DataFrame:
    """df with the document of a text column by a configuration; a column of that name is replaced."""
    normalize(config)

    recent = _Recent(config)

    def cutter(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        recent.age()
        known: dict[str, int] = {}
        parts: list[tuple[int, ...]] = []  # the terms of each distinct word
        terms: dict[str | None, int] = {}
        out: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts.to_pylist()):
            if t is None:
                continue
            before = len(out)
            for w in _WORD.findall(t):
                k = known.get(w)
                if k is None:
                    known[w] = k = len(parts)
                    parts.append(tuple([terms.setdefault(x, len(terms)) for x in recent.terms(w)]))
                out += parts[k]
            counts[i] = len(out) - before
        words = pa.array(list(terms), pa.string())
        return words.take(pa.array(out, pa.int32())), counts

    kept = [column(df, c) for c in df.columns if c.lower() != doc.lower() and (keep_text or c != text)]
    return batches.with_documents(df.select(*kept, column(df, text).cast("string").alias("__text")), doc, cutter)

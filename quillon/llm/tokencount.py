"""Token counts of byte-level BPE, without making the tokens.

Pre-tokens that a worker has not met are merged in batches: their symbols lie in one
ragged array, and each round applies to every sequence its pair of lowest rank, in all
sequences at once; a sequence that has no ranked pair left is done, and its surviving
symbols are its count. Within a sequence all places of that pair are merged in the same
round, from the left, up to one beside which a pair of a lower rank comes up. Before
that each pre-token falls apart between bytes that stand beside each other in no token
of the vocabulary: no merge crosses such a place, so the parts are sequences of their
own, and a very long pre-token is a batch of short ones.

Rounds are as many as the longest part has distinct pairs to merge, at any length.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import append

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of up to so many pre-tokens are kept in a worker.
KEPT, KEPT_CHARS = 600_000, 48
_NONE = np.int64(1 << 40)


class Merges:
    """The ranks of a vocabulary, by pairs of symbols."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.concatenate([np.array(keys, np.int64)[order], [np.int64(1) << 60]])
        self.values = np.concatenate([np.array(values, np.int64)[order], [_NONE]])
        #: Symbols with a pair of a rank below their own: after such a merge the lowest rank may fall.
        self.restless = np.zeros(max(ranks.values(), default=0) + 1, bool)
        keys, values = self.keys[:-1], self.values[:-1]
        for part in (keys >> 20, keys & ((1 << 20) - 1)):
            self.restless[part[part > values]] = True
        joined = np.frombuffer(b"".join(ranks), np.uint8)
        ends = np.cumsum([len(t) for t in ranks])[:-1] - 1
        inner = np.ones(max(len(joined) - 1, 0), bool)
        inner[ends[ends < len(inner)]] = False
        #: Which pairs of bytes stand beside each other in some token.
        self.beside = np.zeros((256, 256), bool)
        self.beside[joined[:-1][inner], joined[1:][inner]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each sequence of bytes."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        if not len(raw):
            return np.zeros(len(tokens), np.int64)
        cut = np.ones(len(raw), bool)
        cut[1:] = ~self.beside[raw[:-1], raw[1:]]
        at = np.cumsum(lengths) - lengths
        cut[at[lengths > 0]] = True
        first = np.flatnonzero(cut)
        parts = self._merge(self.byte[raw], first, np.diff(first, append=len(raw)))
        total = np.concatenate([[0], np.cumsum(parts)])
        return total[np.searchsorted(first, at + lengths)] - total[np.searchsorted(first, at)]

    def _merge(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols that survive in each of the sequences that lie one after the other."""
        out = size.copy()
        rank = np.full(len(symbols), _NONE)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        rank[first + size - 1] = _NONE
        live = np.arange(len(size))
        while len(live):
            lowest = np.minimum.reduceat(rank, first)
            go = lowest < _NONE
            if not go.all():
                out[live[~go]] = size[~go]
                keep = np.repeat(go, size)
                symbols, rank = symbols[keep], rank[keep]
                live, size, lowest = live[go], size[go], lowest[go]
                if not len(live):
                    break
                first = np.cumsum(size) - size
            places = np.flatnonzero(rank == np.repeat(lowest, size))
            owner = np.searchsorted(first, places, "right") - 1
            # of places that overlap (a run of one symbol) every second one from the left
            run = np.ones(len(places), bool)
            run[1:] = places[1:] != places[:-1] + 1
            begin = np.flatnonzero(run)
            inside = np.arange(len(places)) - np.repeat(begin, np.diff(begin, append=len(places)))
            places, owner = places[inside % 2 == 0], owner[inside % 2 == 0]
            at = self._before_lower(symbols, lowest, first, first + size - 1, places, owner)
            at, owner = places[at], owner[at]
            symbols[at] = lowest[owner]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            size = size - np.bincount(owner, minlength=len(size))
            moved = np.cumsum(keep)[at] - 1
            symbols, rank = symbols[keep], rank[keep]
            first = np.cumsum(size) - size
            last = first + size - 1
            inner = moved < last[owner]
            rank[moved] = _NONE
            rank[moved[inner]] = self.rank(symbols[moved[inner]], symbols[moved[inner] + 1])
            head = moved > first[owner]
            before = moved[head] - 1
            rank[before] = self.rank(symbols[before], symbols[moved[head]])
        return out

    def _before_lower(self, symbols: np.ndarray, lowest: np.ndarray, first: np.ndarray, last: np.ndarray, places: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which places are merged before a pair of a lower rank comes up in their sequence: all up to the first that makes one."""
        doubt = np.flatnonzero(self.restless[lowest[owner]])
        out = np.ones(len(places), bool)
        if not len(doubt):
            return out
        at, of = places[doubt], owner[doubt]
        new = lowest[of]
        beside = np.zeros(len(doubt), bool)
        beside[1:] = at[1:] == at[:-1] + 2
        left = np.where(beside, new, symbols[np.maximum(at - 1, 0)])
        right = symbols[np.minimum(at + 2, len(symbols) - 1)]
        lower = ((at > first[of]) & (self.rank(left, new) < new)) | ((at + 2 <= last[of]) & (self.rank(new, right) < new))
        before = np.cumsum(lower) - lower
        begin = np.ones(len(of), bool)
        begin[1:] = of[1:] != of[:-1]
        start = np.flatnonzero(begin)
        out[doubt] = before == np.repeat(before[start], np.diff(start, append=len(of)))
        return out


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=4)
def _tables(data: bytes, pattern: str) -> tuple[Merges, object, dict[str, int]]:
    return Merges(ranks_of(data)), regex.compile(pattern).findall, {}


def count_texts(texts: list[str | None], data: bytes, pattern: str = PATTERN) -> list[tuple[int, int]]:
    """Tokens and pre-tokens of each text; (0, 0) for null."""
    merges, find, kept = _tables(data, pattern)
    split = [find(t) if t else [] for t in texts]
    new = list({w for words in split for w in words if w not in kept})
    fresh = dict(zip(new, merges.counts([w.encode() for w in new]).tolist(), strict=True))
    if len(kept) + len(fresh) > KEPT:
        old = {w: kept[w] for words in split for w in words if w in kept}
        kept.clear()
        kept.update(old)
    kept.update(fresh)
    out = [(sum(map(kept.__getitem__, words)), len(words)) for words in split]
    for w in new:
        if len(w) > KEPT_CHARS:
            del kept[w]
    return out


def count(df: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = PATTERN, drop_text: bool = False) -> DataFrame:
    """df with n_tokens and n_pretokens (bigint): null for a null text, 0 for an empty one. Columns of these names are replaced."""
    data = Path(ranks).read_bytes()

    def run(batch: pa.RecordBatch) -> tuple[None, list[pa.Array]]:
        column = batch.column(batch.schema.names.index(text))
        texts, out, row, size = column.to_pylist(), [], 0, 0
        for i, t in enumerate(texts):  # by about 2 million characters
            size += len(t) if t else 0
            if size > 2_000_000 or i == len(texts) - 1:
                out += count_texts(texts[row : i + 1], data, pattern)
                row, size = i + 1, 0
        null = column.is_null().to_numpy(False)
        tokens = np.array(out, np.int64).reshape(-1, 2)
        return None, [pa.array(tokens[:, 0].copy(), mask=null), pa.array(tokens[:, 1].copy(), mask=null)]

    return append(df, run, "n_tokens bigint, n_pretokens bigint", needs=[text], drop=[text] * drop_text)

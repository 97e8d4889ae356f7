"""Language identification of mixed documents.

Each language has a model of hashed byte trigrams, counted over all documents that
carry its name. A document's words are the units: a word's likelihood in a language
is the product of those of its trigrams. Expectation-maximisation gives the shares
of the languages: a document's rounds go on until its log-likelihood is proven to be
within GAP of the greatest one (the likelihood is concave in the shares, so that its
gradient bounds what is left), however many that takes. A penalised likelihood
(penalty * log(words) for each further language) gives the set: from all languages,
that of the smallest share goes as long as the penalised likelihood grows. Where the
bound shows that all languages together are within one penalty of one alone, no set of
two or more can be better and the rounds end at once.

Null texts, and texts without words, have null results. Documents without a language
name count for no model but are analysed. Without any named document all is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import append, field

BITS = 15
PENALTY = 1.5
#: What the log-likelihood of a document may fall short of its maximum, and for each of its words (rounding).
GAP, GAP_A_WORD = 0.01, 1e-6

_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigrams(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, the start of each word among them, and the offsets of texts in words."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "") if column.null_count else column
    raw, _ = arrays.buffer(column)
    if raw.size and raw.max() >= 128:
        column = pc.utf8_lower(column)
    raw, at = arrays.buffer(column)
    n = raw.size
    kind = np.full(n + 2, 32, np.uint32)
    kind[1:-1] = _CLASS[raw]
    inside = kind[1:-1] != 32
    left, right = kind[:-2].copy(), kind[2:].copy()
    if n:
        edges = at[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        left[edges] = 32
        right[edges - 1] = 32
    code = (left * np.uint32(0x85EBCA6B) + kind[1:-1] * np.uint32(0xC2B2AE35) + right * np.uint32(0x27D4EB2F)) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
    spots = np.flatnonzero(inside)
    starts = np.flatnonzero(left[spots] == 32)
    return code[spots].astype(np.int32), starts, np.searchsorted(spots[starts], at) if len(starts) else np.zeros(len(at), np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Names of the languages and log-likelihoods (trigram, language), from all named documents."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = batch.column(0), batch.column(1).to_pylist()
            for a, b in arrays.slices(texts):
                code, starts, offsets = trigrams(texts.slice(a, b - a), bits)
                word = np.concatenate([starts, [len(code)]])
                known = sorted(set(names[a:b]))
                owner = np.repeat(np.repeat(np.array([known.index(x) for x in names[a:b]], np.int64), np.diff(offsets)), np.diff(word))
                counts = np.bincount((owner << bits) + code, minlength=len(known) << bits).reshape(len(known), -1)
                for k, name in enumerate(known):
                    total[name] = total.get(name, 0) + counts[k]
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])

    named = docs.select(field(docs, text).alias("__text"), field(docs, lang).cast("string").alias("__lang")).where("__text is not null and __lang is not null")
    rows = named.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x 2**bits rows at most
    names = sorted(rows["lang"].unique().tolist())
    counts = np.full((1 << bits, len(names)), smoothing)
    if names:
        counts[rows["bucket"].to_numpy(), np.searchsorted(names, rows["lang"].to_numpy(str))] += rows["n"].to_numpy()
    return names, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32)


def mixture(like: np.ndarray, offsets: np.ndarray, allowed: np.ndarray, start: np.ndarray, enough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages and log-likelihood of each document; like: scaled likelihoods of its words.

    enough: log-likelihoods; a document that is proven not to get above its own needs no further rounds.
    """
    counts = np.diff(offsets)
    share = np.where(allowed, np.maximum(start, 1e-9), 0.0)
    share /= share.sum(1, keepdims=True)
    total = np.zeros(len(counts))
    gap = GAP + GAP_A_WORD * counts
    live, rows, to = np.arange(len(counts)), like, offsets
    while len(live):
        mixed = (rows * np.repeat(share[live].astype(np.float32), counts[live], axis=0)).sum(1) + np.float32(1e-30)
        now = np.add.reduceat(np.log(mixed), to[:-1], dtype=np.float64)
        # the gradient of the mean log-likelihood: 1 for a language in its place, more for one that is worth more
        gain = np.add.reduceat(rows / mixed[:, None], to[:-1], axis=0, dtype=np.float64) / counts[live][:, None]
        left = counts[live] * np.maximum(np.where(allowed[live], gain, 0).max(1) - 1, 0)
        done = left <= gap[live]
        if enough is not None:
            done |= now + left <= enough[live]
        total[live] = now
        go = ~done
        if not go.all():
            rows = rows[np.repeat(go, counts[live])]
            live, gain = live[go], gain[go]
            to = np.concatenate([[0], np.cumsum(counts[live])])
        share[live] *= gain
        share[live] /= share[live].sum(1, keepdims=True)
    return share, total


def select(like: np.ndarray, offsets: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares (0 for languages outside the selected set) and penalised log-likelihood of documents of one word at least."""
    n, k = len(offsets) - 1, like.shape[1]
    counts = np.diff(offsets)
    cost = penalty * np.log(np.maximum(counts, 2))
    alone = np.add.reduceat(np.log(like + np.float32(1e-30)), offsets[:-1], axis=0, dtype=np.float64)
    single = alone.argmax(1)
    best = alone[np.arange(n), single]
    share = np.zeros((n, k))
    share[np.arange(n), single] = 1
    if k < 2:
        return share, best
    allowed = np.ones((n, k), bool)
    full, total = mixture(like, offsets, allowed, np.full((n, k), 1 / k), best + cost)
    live = np.flatnonzero(total - cost > best)
    allowed, now, total = allowed[live], full[live], total[live]
    size = np.full(len(live), k)
    while len(live):
        value = total - cost[live] * (size - 1)
        better = value > best[live]
        share[live[better]], best[live[better]] = now[better], value[better]
        go = size > 2
        live, allowed, now, size = live[go], allowed[go], now[go], size[go] - 1
        if not len(live):
            break
        least = np.where(allowed, now, np.inf).argmin(1)
        allowed[np.arange(len(live)), least] = False
        to = np.concatenate([[0], np.cumsum(counts[live])])
        now, total = mixture(like[arrays.ragged_positions(offsets[live], counts[live])], to, allowed, np.maximum(now, 1e-3))
    return share, best


def detect(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", bits: int = BITS, penalty: float = PENALTY, drop_text: bool = False) -> DataFrame:
    """docs with language (of the largest share), languages and shares (largest first, ties by name), n_words. Columns of these names are replaced."""
    names, table = model

    def run(batch: pa.RecordBatch) -> tuple[None, list[pa.Array]]:
        column = batch.column(batch.schema.names.index(text))
        top, sets, shares, words = [], [], [], []
        for a, b in arrays.slices(column):
            code, starts, offsets = trigrams(column.slice(a, b - a), bits)
            counts = np.diff(offsets)
            words += counts.tolist()
            full = counts > 0
            out: list[tuple | None] = [None] * (b - a)
            if names and full.any():
                logs = np.add.reduceat(table[code], starts, axis=0)
                logs -= logs.max(1, keepdims=True)
                got, _ = select(np.exp(logs), np.concatenate([[0], np.cumsum(counts[full])]), penalty)
                for i, row in zip(np.flatnonzero(full), got, strict=True):
                    order = sorted(np.flatnonzero(row > 0), key=lambda j, row=row: (-row[j], names[j]))
                    out[i] = ([names[j] for j in order], [round(float(row[j]), 6) for j in order])
            for x in out:
                top.append(x[0][0] if x else None)
                sets.append(x[0] if x else None)
                shares.append(x[1] if x else None)
        null = column.is_null().to_numpy(False)
        return None, [pa.array(top, pa.string()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(np.array(words, np.int64), mask=null)]

    return append(docs, run, "language string, languages array<string>, shares array<double>, n_words bigint", needs=[text], drop=[text] * drop_text)

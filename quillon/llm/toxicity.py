"""Toxicity by the nearest labelled examples.

Terms are words and the first PREFIXES bytes of longer ones, hashed to 2**BITS; a text's
vector has (1 + ln tf) * ln((1 + documents) / (1 + document frequency)) for every term, of
length one. Document frequencies are counted over all documents. The examples, at most
SAMPLE of each class in SHARE (those of the smallest hashes), lie in an inverted index
whose postings come in blocks of examples with the greatest weight of each term; terms of
over DENSE of the examples have their postings as rows of a matrix, one place for each
example. For a text the products with the matrix and the block maxima of the other terms
bound the cosine of every block; the blocks of the greatest bounds are scored first, and
then those whose bound reaches the k-th best cosine so far: the k nearest by cosine over
all terms are exact. Each votes with its cosine; the share of the toxic votes, through a
logistic curve fitted to the examples' own votes (each left out of its index) at the
classes' shares among all labels, is the score. Evidence are examples of the sample.

Ids may be of any type. Null texts have null scores; a text that shares no term with any example has votes of
zero. Equal cosines: the example of the smaller id first. Labels that are null, or of
missing or null texts, take no part; of the rows of one id the text of the smallest hash
is the example. Without examples of both classes scores are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import arrays
from .common import append, field, packed_counts

BITS, NEAREST, BLOCK, EVIDENCE = 20, 128, 64, 5
#: Bytes of the prefixes of longer words that are terms too, as rough stems.
PREFIXES = (4, 6, 8)
#: The most examples of each class.
SAMPLE, SHARE = 2048, {1: 0.5, 0: 1.0}
#: Share of the examples from which on a term's postings are a row of the matrix.
DENSE = 0.1
#: Texts are scored together up to so many postings and scores; a text with more is scored alone.
_POSTINGS = 1_000_000


def terms(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and count, ordered by text and term."""
    words = arrays.Words(column)
    cuts = [words.prefixes(size) for size in PREFIXES]
    text = np.concatenate([np.repeat(np.arange(len(words.counts)), words.counts), *[own for _, own in cuts]])
    term = np.concatenate([words.hashes, *[cut for cut, _ in cuts]]) >> np.uint64(64 - bits)
    key, many = np.unique(text << bits | term.astype(np.int64), return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), many


def frequencies(docs: DataFrame, text: str = "text", bits: int = BITS) -> tuple[np.ndarray, int]:
    """Document frequencies of all terms, and the number of documents with a text."""

    def counted(batches):
        total = np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            column = batch.column(0)
            total[-1] += len(column)
            for a, b in arrays.slices(column):
                total[:-1] += np.bincount(terms(column.slice(a, b - a), bits)[1], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield at, total[at]

    out = packed_counts(docs.select(field(docs, text).alias("__text")).where("__text is not null"), counted, (1 << bits) + 1)
    return out[:-1], int(out[-1])


class Index:
    """The examples as blocks of postings, and the curve of the votes."""

    def __init__(self, keys: list, toxic: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], df: np.ndarray, n: int, prior: float, k: int = NEAREST, bits: int = BITS, dense: float = DENSE, key_type: T.DataType | None = None):
        self.key_type = key_type or T.LongType()
        self.keys, self.toxic, self.k, self.bits = keys, np.asarray(toxic, bool), min(k, max(len(keys) - 1, 1)), bits
        example = np.repeat(np.arange(len(keys)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors])
        count = np.concatenate([c for _, c in vectors])
        self.idf = np.log((1 + n) / (1 + df)).astype(np.float32)
        weight = self.weigh(example, term, count, len(keys))
        keep = weight > 0
        example, term, weight = example[keep], term[keep], weight[keep]
        common = np.flatnonzero(np.bincount(term, minlength=1 << bits) > dense * len(keys))
        self.row = np.full(1 << bits, -1, np.int32)
        self.row[common] = np.arange(len(common))
        here = self.row[term] >= 0
        self.matrix = np.zeros((len(common), len(keys)), np.float32)
        self.matrix[self.row[term[here]], example[here]] = weight[here]
        example, term, weight = example[~here], term[~here], weight[~here]
        order = np.lexsort((example, term))
        self.example, self.weight, term = example[order].astype(np.int32), weight[order], term[order]
        self.blocks = -(-len(keys) // BLOCK)
        entry = term * self.blocks + self.example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
        self.start = np.concatenate([first, [len(entry)]]).astype(np.int32)
        self.block = (entry[first] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.at = np.searchsorted(term[first], np.arange((1 << bits) + 1)).astype(np.int32)
        self.slope, self.shift = self.calibrate(vectors, prior)

    def weigh(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[term]
        length = np.sqrt(np.bincount(text, w * w, n))
        return (w / np.maximum(length, 1e-12)[text]).astype(np.float32)

    def nearest(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, without: np.ndarray | None = None, prune: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples of n texts and their cosines, nearest first; without: an example of each text to leave out."""
        keep = weight > 0
        text, term, weight = text[keep], term[keep], weight[keep]
        near, cosine = np.zeros((n, self.k), np.int64), np.zeros((n, self.k), np.float32)
        entries = self.at[term + 1] - self.at[term]
        postings = self.start[self.at[term + 1]] - self.start[self.at[term]]
        load = np.concatenate([[0], np.cumsum(np.bincount(text, postings, n) + len(self.keys) + len(self.matrix))])
        row = 0
        while row < n:
            to = min(max(int(np.searchsorted(load, load[row] + _POSTINGS, "right")) - 1, row + 1), n)
            a, b = np.searchsorted(text, [row, to])
            self._score(text[a:b] - row, term[a:b], weight[a:b], entries[a:b], near[row:to], cosine[row:to], None if without is None else without[row:to], prune)
            row = to
        return near, cosine

    def _score(self, text, term, weight, entries, near, cosine, without, prune) -> None:
        n, many, k = len(near), len(self.keys), self.k
        common = self.row[term]
        own = np.flatnonzero(common >= 0)
        query = np.zeros((n, len(self.matrix)), np.float32)
        query[text[own], common[own]] = weight[own]
        score = np.zeros((n, self.blocks * BLOCK), np.float32)
        score[:, :many] = query @ self.matrix
        entry = arrays.ragged_positions(self.at[term], entries)
        owner, w = np.repeat(text, entries), np.repeat(weight, entries)
        cell = owner * self.blocks + self.block[entry]
        bound = np.bincount(cell, w * self.most[entry], n * self.blocks).reshape(n, self.blocks) + score.reshape(n, self.blocks, BLOCK).max(2) + 1e-6
        scored = np.zeros(bound.shape, bool)

        def add(chosen: np.ndarray) -> None:
            scored[chosen] = True
            pick = np.flatnonzero(chosen.ravel()[cell])
            size = self.start[entry[pick] + 1] - self.start[entry[pick]]
            post = arrays.ragged_positions(self.start[entry[pick]], size)
            score.ravel()[:] += np.bincount(np.repeat(owner[pick], size) * score.shape[1] + self.example[post], np.repeat(w[pick], size) * self.weight[post], score.size)

        def best() -> np.ndarray:
            real = np.where(np.repeat(scored, BLOCK, axis=1)[:, :many], score[:, :many], np.float32(-1))
            if without is not None:
                real[np.arange(n), without] = -1
            return real

        if prune and self.blocks > -(-k // BLOCK) + 1:
            lead = -(-k // BLOCK) + 1
            chosen = np.zeros(bound.shape, bool)
            np.put_along_axis(chosen, np.argpartition(-bound, lead - 1, axis=1)[:, :lead], True, axis=1)
            add(chosen)
            least = np.partition(best(), many - k, axis=1)[:, many - k]
            add((bound >= least[:, None]) & ~chosen)
        else:
            add(np.ones(bound.shape, bool))
        real = best()
        top = np.argpartition(-real, k - 1, axis=1)[:, :k] if k < many else np.tile(np.arange(many), (n, 1))
        # ties at the edge go to the smaller number
        edge = np.take_along_axis(real, top, 1).min(1)
        tied = (real == edge[:, None]).sum(1) > (np.take_along_axis(real, top, 1) == edge[:, None]).sum(1)
        for i in np.flatnonzero(tied & (edge > 0)):
            top[i] = np.lexsort((np.arange(many), -real[i]))[:k]
        order = np.lexsort((top, -np.take_along_axis(real, top, 1)), axis=1)
        near[:] = np.take_along_axis(top, order, 1)
        cosine[:] = np.maximum(np.take_along_axis(real, near, 1), 0)

    def votes(self, near: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        return (cosine * self.toxic[near]).sum(1) / np.maximum(cosine.sum(1), 1e-12)

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]], prior: float) -> tuple[float, float]:
        n = len(self.keys)
        text = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        term, count = np.concatenate([t for t, _ in vectors]), np.concatenate([c for _, c in vectors])
        v = self.votes(*self.nearest(text, term, self.weigh(text, term, count, n), n, np.arange(n)))
        weight = np.where(self.toxic, prior / max(self.toxic.mean(), 1e-9), (1 - prior) / max(1 - self.toxic.mean(), 1e-9))
        x = np.stack([v, np.ones(n)], 1)
        b = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (weight * (p - self.toxic)) + 1e-3 * b)
            b = b - np.clip(step, -5, 5)
        return float(b[0]), float(b[1])

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and nearest examples and cosines, of texts."""
        text, term, count = terms(column, self.bits)
        n = len(column)
        near, cosine = self.nearest(text, term, self.weigh(text, term, count, n), n)
        return 1 / (1 + np.exp(-(self.slope * self.votes(near, cosine) + self.shift))), near, cosine


def build(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, k: int = NEAREST, bits: int = BITS) -> Index | None:
    """The index of a sample of labelled documents; None without both classes."""
    named = labels.select(field(labels, key).alias("__key"), (field(labels, label).cast("int") > 0).cast("int").alias("__toxic")).where("__key is not null and __toxic is not null")
    shares = {r["__toxic"]: r["count"] for r in named.groupBy("__toxic").count().collect()}
    if len(shares) < 2:
        return None
    chosen = None
    for c in (1, 0):
        part = named.where(F.col("__toxic") == c).distinct().orderBy(F.xxhash64("__key"), "__key").limit(int(sample * SHARE[c]))
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(field(docs, key).alias("__key"), field(docs, text).alias("__text")).where("__text is not null")

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            for a, b in arrays.slices(column):
                text_, term, count = terms(column.slice(a, b - a), bits)
                at = np.searchsorted(text_, np.arange(b - a + 1))
                rows = [(term[at[i] : at[i + 1]].astype("<i4").tobytes(), count[at[i] : at[i + 1]].astype("<i4").tobytes()) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "toxic", "terms", "counts"])

    # an id that many rows have is one example
    one = texts.join(F.broadcast(chosen), "__key").groupBy("__key", "__toxic").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    rows = one.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, toxic int, terms binary, counts binary").collect()  # sample of each class at most
    rows.sort(key=lambda r: (r.key, r.toxic, r.terms))
    if len({r.toxic for r in rows}) < 2:
        return None
    df, n = frequencies(docs, text, bits)
    vectors = [(np.frombuffer(r.terms, "<i4").astype(np.int64), np.frombuffer(r.counts, "<i4")) for r in rows]
    return Index([r.key for r in rows], np.array([r.toxic for r in rows]), vectors, df, n, shares[1] / (shares[0] + shares[1]), k, bits, key_type=docs.schema[key].dataType)


def score(docs: DataFrame, index: Index | None, text: str = "text", threshold: float = 0.5, drop_text: bool = False) -> DataFrame:
    """docs with toxicity, toxic (toxicity >= threshold) and evidence (the nearest examples: id, cosine, toxic). Columns of these names are replaced."""
    key = index.key_type if index is not None else T.LongType()
    kind = pa.list_(pa.struct([("example", to_arrow_type(key)), ("cosine", pa.float64()), ("toxic", pa.bool_())]))

    def run(batch: pa.RecordBatch) -> tuple[None, list[pa.Array]]:
        column = batch.column(batch.schema.names.index(text))
        null = column.is_null().to_numpy(False)
        n = len(column)
        if index is None:
            return None, [pa.nulls(n, pa.float64()), pa.nulls(n, pa.bool_()), pa.nulls(n, kind)]
        p, size = np.zeros(n), np.zeros(n, np.int64)
        example, cosine = [], []
        for a, b in arrays.slices(column):
            p[a:b], near, cos = index.score(column.slice(a, b - a))
            near, cos = near[:, :EVIDENCE], cos[:, :EVIDENCE]
            size[a:b] = (cos > 0).sum(1)
            example.append(near[cos > 0])
            cosine.append(cos[cos > 0])
        example = np.concatenate(example) if example else np.zeros(0, np.int64)
        cosine = np.concatenate(cosine) if cosine else np.zeros(0)
        values = pa.StructArray.from_arrays([pa.array([index.keys[i] for i in example.tolist()], kind.value_type[0].type), pa.array(cosine.astype(np.float64)), pa.array(index.toxic[example])], fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values, mask=pa.array(null))
        return None, [pa.array(p, mask=null), pa.array(p >= threshold, mask=null), lists]

    return append(docs, run, f"toxicity double, toxic boolean, evidence array<struct<example: {key.simpleString()}, cosine: double, toxic: boolean>>", needs=[text], drop=[text] * drop_text)

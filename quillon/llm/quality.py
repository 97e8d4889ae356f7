"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A text's score is the mean weight of its hashed byte trigrams (those of a word that
repeats the one before it are one feature of their own), one set of weights for all grades; ordered thresholds cut the scores: P(grade <= k) = sigmoid(t[k] - s).
The expected grade and the tail probability P(grade >= a chosen one) follow, and the
tail probability selects. The model is fitted in one task, by full-batch gradients,
on at most SAMPLE rated texts (those of the smallest hashes of their ids).

Null and empty texts have null results and are not kept. Ratings that are null, and
ratings of texts that are missing, take no part; of the rows of one id the text of the
smallest hash is rated; with fewer than two grades among the
rest every text has that grade with certainty (and null without any).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .common import append, field

#: The most rated texts to fit on.
SAMPLE = 4096
BITS = 16


def repeated(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes lie in a word (a run without blanks) that equals the one before it in its text."""
    n = len(raw)
    power, inverse = arrays._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    word = (raw != 32) & (raw != 10)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    end = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    code = arrays.mix((total[end] - total[start]) * inverse[start])
    own = np.searchsorted(offsets, start, "right")
    again = np.flatnonzero((code[1:] == code[:-1]) & (own[1:] == own[:-1])) + 1
    depth = np.zeros(n + 1, np.int8)
    depth[start[again]] += 1
    depth[end[again]] -= 1  # words don't touch within a text, and one that ends a text ends where none that repeats begins
    return np.cumsum(depth[:n], dtype=np.int8) > 0


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of texts and their offsets; texts of one or two bytes have one of what is there.

    The trigrams of a word that repeats the one before it are feature 0, whatever they are.
    """
    counts = np.diff(offsets)
    padded = np.concatenate([raw, np.zeros(2, np.uint8)]).astype(np.uint32)
    codes = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    codes *= np.uint32(0x9E3779B1)
    codes >>= np.uint32(32 - bits)
    codes = np.where(repeated(raw, offsets), np.uint32(0), np.maximum(codes, np.uint32(1))) if len(raw) else codes
    many = np.maximum(counts - 2, np.minimum(counts, 1))
    keep = np.ones(len(raw), bool)
    for back in (1, 2):
        at = offsets[1:] - back
        keep[at[counts > back]] = False
    return codes[keep].astype(np.int32), np.concatenate([[0], np.cumsum(many)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss(w: np.ndarray, theta: np.ndarray, grades: np.ndarray, index: np.ndarray, value: np.ndarray, offsets: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood with its penalty, and its gradients by weights and by theta (the first threshold and the logarithms of the gaps)."""
    many = len(theta)
    s = arrays.sums(w[index] * value, offsets)
    cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    hi, lo = edge[grades + 1] - s, edge[grades] - s
    p_hi, p_lo = np.where(np.isinf(hi), 1.0, _sigmoid(hi)), np.where(np.isinf(lo), 0.0, _sigmoid(lo))
    p = np.maximum(p_hi - p_lo, 1e-9)
    d_hi, d_lo = p_hi * (1 - p_hi) / p, p_lo * (1 - p_lo) / p
    row = np.repeat(np.arange(len(grades)), np.diff(offsets))
    gw = np.bincount(index, ((d_hi - d_lo) / len(grades))[row] * value, len(w)) + penalty * w
    dcut = np.zeros(many)
    np.add.at(dcut, np.minimum(grades, many - 1), np.where(grades < many, -d_hi, 0) / len(grades))
    np.add.at(dcut, np.maximum(grades - 1, 0), np.where(grades > 0, d_lo, 0) / len(grades))
    below = np.cumsum(dcut[::-1])[::-1]
    return float(-np.log(p).mean() + penalty / 2 * (w @ w)), gw, np.concatenate([below[:1], below[1:] * np.exp(theta[1:])])


def fit(grades: np.ndarray, index: np.ndarray, value: np.ndarray, offsets: np.ndarray, bits: int = BITS, steps: int = 150, penalty: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for grades 0, 1, ... of rows of sparse features, by Adam on all rows."""
    share = np.array([(grades <= k).mean() for k in range(int(grades.max()))]).clip(1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    theta = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    w = np.zeros(1 << bits)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, theta)]
    for step in range(1, steps + 1):
        _, gw, gt = loss(w, theta, grades, index, value, offsets, penalty)
        for x, g, (m, v), rate in ((w, gw, moments[0], 0.5), (theta, gt, moments[1], 0.05)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def _fit_batch(batch: pa.Table, bits: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    texts = batch.column("__text").combine_chunks()
    values, y = np.unique(batch.column("__grade").to_numpy(), return_inverse=True)
    if len(values) < 2:
        return values.tolist(), np.zeros(1 << bits), np.zeros(0)
    index, value, sizes = [], [], []
    for a, b in arrays.slices(texts):
        codes, offsets = features(*arrays.buffer(texts.slice(a, b - a)), bits)
        for i in range(b - a):
            own, many = np.unique(codes[offsets[i] : offsets[i + 1]], return_counts=True)
            index.append(own)
            value.append(many / max(many.sum(), 1))
            sizes.append(len(own))
    w, t = fit(y, np.concatenate(index), np.concatenate(value), np.concatenate([[0], np.cumsum(sizes)]), bits)
    return values.tolist(), w, t


def train(docs: DataFrame, ratings: DataFrame, text: str = "text", key: str = "doc_id", grade: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """The grades, weights and thresholds; None without any rated text."""
    rated = ratings.select(field(ratings, key).alias("__key"), field(ratings, grade).cast("int").alias("__grade")).where("__key is not null and __grade is not null")
    chosen = rated.orderBy(F.xxhash64("__key"), "__key", "__grade").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(field(docs, key).alias("__key"), field(docs, text).alias("__text")).where("__text is not null and __text != ''")
    # an id that many rows have is one rated text for each of its grades
    rows = texts.join(F.broadcast(chosen), "__key").groupBy("__key", "__grade").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).select("__text", "__grade")

    def one(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("__grade").to_numpy(), [zlib.crc32(x.encode()) for x in table.column("__text").to_pylist()]))
        grades, w, t = _fit_batch(table.take(pa.array(order)), bits)
        return pa.table({"grades": pa.array([grades], pa.list_(pa.int32())), "w": pa.array([w.astype("<f4").tobytes()], pa.binary()), "t": pa.array([t.tolist()], pa.list_(pa.float64()))})

    got = rows.groupBy(F.lit(1).alias("__one")).applyInArrow(one, "grades array<int>, w binary, t array<double>").collect()
    return (got[0].grades, np.frombuffer(got[0].w, "<f4"), np.array(got[0].t)) if got else None


def score(docs: DataFrame, model: tuple[list[int], np.ndarray, np.ndarray] | None, text: str = "text", at_least: int = 1, probability: float = 0.5, select: bool = False, bits: int = BITS, drop_text: bool = False) -> DataFrame:
    """docs with expected_grade, tail_probability (of grade at_least or more) and keep (tail_probability >= probability).

    With select, only the kept rows and only the columns of docs.
    """

    def run(batch: pa.RecordBatch) -> tuple[object, list[pa.Array]]:
        column = batch.column(batch.schema.names.index(text))
        n = len(column)
        expected, tail = np.full(n, np.nan), np.full(n, np.nan)
        if model is not None:
            grades, w, t = np.array(model[0], float), model[1], model[2]
            for a, b in arrays.slices(column):
                codes, offsets = features(*arrays.buffer(column.slice(a, b - a)), bits)
                size = np.diff(offsets)
                s = arrays.sums(w[codes].astype(np.float64), offsets) / np.maximum(size, 1)
                below = np.concatenate([np.zeros((b - a, 1)), 1 / (1 + np.exp(-np.clip(t[None] - s[:, None], -40, 40))), np.ones((b - a, 1))], axis=1)
                p = np.diff(below, axis=1)
                expected[a:b] = np.where(size > 0, p @ grades, np.nan)
                tail[a:b] = np.where(size > 0, p[:, grades >= at_least].sum(1), np.nan)
        keep = np.nan_to_num(tail, nan=-1.0) >= probability
        if select:
            return pa.array(keep), []
        no = np.isnan(expected)
        return None, [pa.array(expected, mask=no), pa.array(tail, mask=no), pa.array(keep)]

    if select:
        return append(docs, run, T.StructType([]))
    return append(docs, run, "expected_grade double, tail_probability double, keep boolean", needs=[text], drop=[text] * drop_text)

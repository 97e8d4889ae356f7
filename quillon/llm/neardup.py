"""Near-duplicate documents: MinHash, banding, sequential Bayesian verification, exact Jaccard.

Texts are sets of runs of SHINGLE words in lower case (characters of scripts without
blanks are words of their own); two are near duplicates if their Jaccard similarity is
at least threshold. Equal texts are one node, keyed by a 64-bit hash of the text; where
different texts share a hash (a second one tells) they get keys of their own. Nodes that
share a band of their signatures lie in a bucket. A pair of nodes is compared batch of
hashes by batch: with m of n equal, the posterior of the similarity (uniform prior) is
Beta(m + 1, n - m + 1), and the pair goes as soon as P(similarity >= threshold) falls
below miss. The texts of the pairs that stay are compared exactly.

Groups are the connected components of the verified pairs. Not every pair of a bucket is
needed for them. First each node is compared with the least node of its bucket, so large
groups of copies take as many comparisons as they have nodes. What is left are pairs of
one bucket whose nodes are in different components. All of them that can be similar
follow, without meeting all the others: two sets that are similar enough share one of
their rarest shingles (prefix filtering: of the smaller set n - ceil(2t/(1+t) n) + 1, of
the larger n - ceil(t n) + 1), so nodes of such buckets meet over those shingles, and
only nodes of different components do. A passage that many texts share makes buckets of
them but is not among their rarest shingles. Nothing is capped: groups are those of all
pairs of the buckets (and of some pairs that no band brought together).

Null texts are in no group. Texts without words are near only to equal ones. Of a
group the row of the smallest id (nulls last, then the smallest hash) is kept; repeated
rows are copies of each other, ids may repeat.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import field, free, packed_counts, release, table

SHINGLE, BANDS, ROWS, THRESHOLD, MISS, BATCH = 3, 32, 5, 0.6, 0.001, 32
#: Shingles are ordered by how often they occur, as counted in 2**ORDER_BITS counters; any order gives the same pairs, a good one meets few others.
ORDER_BITS = 21

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(1 << 32, size=4096, dtype=np.uint32)
_MUL = _rng.integers(1 << 32, size=4096, dtype=np.uint32) | np.uint32(1)


def signatures(column: pa.Array, hashes: int, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures (rows, hashes) of texts and their numbers of shingles; a text without words has none (all ones)."""
    codes, offsets = arrays.Words(column, characters=True).ngrams(shingle)
    many = np.diff(offsets)
    out = np.full((len(many), hashes), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(many)
    if len(full):
        x, first = (codes >> np.uint64(32)).astype(np.uint32) ^ codes.astype(np.uint32), offsets[:-1][full]
        buffer = np.empty_like(x)
        for j in range(hashes):
            np.bitwise_xor(x, _XOR[j], out=buffer)
            np.multiply(buffer, _MUL[j], out=buffer)
            out[full, j] = np.minimum.reduceat(buffer, first)
    return out, many


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys (texts, bands)."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            key = arrays.mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        out[:, b] = key
    return out


def least_matches(compared: int, threshold: float, miss: float) -> int:
    """The fewest equal hashes of compared ones with which P(similarity >= threshold) is at least miss.

    P(Beta(m + 1, n - m + 1) >= t) is P(Binomial(n + 1, t) <= m).
    """
    n, total = compared + 1, 0.0
    for m in range(compared + 1):
        total += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= miss:
            return m
    return compared


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, batch: int) -> np.ndarray:
    """Rows of two arrays of signatures that no batch prunes."""
    live, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for start in range(0, a.shape[1], batch):
        end = min(start + batch, a.shape[1])
        equal[live] += (a[live, start:end] == b[live, start:end]).sum(1)
        live = live[equal[live] >= least_matches(end, threshold, miss)]
    return live


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct shingles."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shingles_of(texts: list[str], shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted; texts are cut a slice at a time."""
    column = pa.array(texts, pa.string())
    for a, b in arrays.slices(column):
        codes, offsets = arrays.Words(column.slice(a, b - a), characters=True).ngrams(shingle)
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            yield np.unique(codes[lo:hi])


def _counters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each shingle."""
    return (codes >> np.uint64(64 - ORDER_BITS)).astype(np.int64), (codes & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)


def _pack(texts: list[str]) -> pa.Array:
    return pa.array([zlib.compress(t.encode(), 1) for t in texts], pa.binary())


def _unpack(z: bytes) -> str:
    return zlib.decompress(z).decode()


class NearDuplicates:
    """The groups of a table of documents.

    rows: (__doc, __node) of all rows with a text; labels: (__node, __group) of the nodes near another one; compared: how many
    pairs were compared, first with the least nodes of buckets and then across components.
    """

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, miss: float = MISS, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, batch: int = BATCH, identity: Callable[[Column], Column] = F.xxhash64):
        self.docs, self.text, self.key, self.identity = docs, text, key, identity
        self.threshold, self.miss, self.shingle, self.bands, self.per_band, self.batch = threshold, miss, shingle, bands, rows, batch
        self.compared = [0, 0]
        source = docs.select(field(docs, key).alias("__doc"), field(docs, text).alias("__text")).where("__text is not null")
        hashed = source.select(identity(F.col("__text")).alias("__hash"), F.xxhash64(F.lit(1), "__text").alias("__other"))
        clashes = table(hashed.groupBy("__hash").agg(F.min("__other").alias("lo"), F.max("__other").alias("hi")).where("lo < hi").select("__hash"), "clashes")
        self.clashes = None if clashes.isEmpty() else clashes
        self.source = self._keyed(source, "__text", "__node")
        self.signed = self._sign()
        self.rows = self.signed.select("__doc", "__node")
        self.labels = self._labels()

    def _keyed(self, df: DataFrame, text: str, node: str) -> DataFrame:
        """df with the node of its text."""
        value = field(df, text)
        if self.clashes is None:
            return df.withColumn(node, self.identity(value))
        clash = self.clashes.select(F.col("__hash").alias("__clash"))
        joined = df.withColumn(node, self.identity(value)).join(clash, F.col(node) == F.col("__clash"), "left")
        own = F.when(F.col("__clash").isNotNull(), F.xxhash64(F.lit(1), field(joined, text))).otherwise(F.col(node))
        return joined.select(*[field(joined, c) for c in df.columns], own.alias(node))

    def _sign(self) -> DataFrame:
        """(__doc, __node, __bands, __sig), the last two for the first row of a node in each task alone."""
        hashes, bands, per_band, shingle = self.bands * self.per_band, self.bands, self.per_band, self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                nodes = batch.column(1).to_pylist()
                first = np.array([not (n in seen or seen.add(n)) for n in nodes], bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(~first)), batch.column(1).filter(pa.array(~first)), pa.nulls(int((~first).sum()), pa.list_(pa.int64())), pa.nulls(int((~first).sum()), pa.binary())], names=names)
                batch = batch.filter(pa.array(first))
                for a, b in arrays.slices(batch.column(2)):
                    sig, many = signatures(batch.column(2).slice(a, b - a), hashes, shingle)
                    keys = band_keys(sig, bands, per_band).astype(np.int64)
                    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * hashes), b - a, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(keys.ravel()), mask=pa.array(many == 0))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists, data], names=names)

        names = ["__doc", "__node", "__bands", "__sig"]
        kind = self.docs.schema[self.key].dataType.simpleString()
        return table(self.source.select("__doc", "__node", "__text").mapInArrow(run, f"__doc {kind}, __node bigint, __bands array<bigint>, __sig binary"), "signatures")

    def _labels(self) -> DataFrame:
        banded = self.signed.where("__bands is not null").select("__node", F.explode("__bands").alias("__band"))
        ends = banded.groupBy("__band").agg(F.min("__node").alias("__least"), F.max("__node").alias("__most")).where("__least < __most")
        buckets = table(banded.join(ends.select("__band", "__least"), "__band").distinct(), "buckets")
        stars = table(buckets.where("__node != __least").select(F.col("__least").alias("__a"), F.col("__node").alias("__b")).distinct(), "stars")
        signed = table(self.signed.select("__node", "__sig").where("__sig is not null").join(buckets.select("__node").distinct(), "__node", "left_semi").dropDuplicates(["__node"]), "candidates")
        edges = self.verify(stars, signed)
        labels = components(edges)
        marked = buckets.join(labels, "__node", "left").select("__band", "__node", F.coalesce("__group", "__node").alias("__group"))
        mixed = marked.groupBy("__band").agg(F.min("__group").alias("lo"), F.max("__group").alias("hi")).where("lo < hi").select("__band")
        apart = table(marked.join(mixed, "__band", "left_semi").select("__node", "__group").distinct(), "apart")
        rest = table(self.across(apart).join(stars, ["__a", "__b"], "left_anti"), "rest")
        self.compared = [stars.count(), rest.count()]
        more = self.verify(rest, signed)
        if not more.isEmpty():
            labels, old = components(edges.unionAll(more)), labels
            release(old)
        release(buckets, stars, signed, edges, apart, rest, more)
        return labels

    def texts(self, nodes: DataFrame, *more: str) -> DataFrame:
        """(__node, __z: the packed text, …) of nodes (__node, …), each from one of its rows."""
        chosen = self.rows.join(nodes.select("__node"), "__node", "left_semi").groupBy("__node").agg(F.min(F.xxhash64("__doc")).alias("__at"))
        wanted = chosen.join(nodes, "__node")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.set_column(1, "__z", _pack(b.column(1).to_pylist()))

        rows = self.source.select("__node", F.xxhash64("__doc").alias("__at"), "__text").join(wanted, ["__node", "__at"]).select("__node", "__text", *more)
        kinds = "".join(f", {c} {nodes.schema[c].dataType.simpleString()}" for c in more)
        return table(rows.mapInArrow(pack, f"__node bigint, __z binary{kinds}").dropDuplicates(["__node"]), "texts")

    def across(self, nodes: DataFrame) -> DataFrame:
        """The pairs (__a, __b), __a < __b, of nodes (__node, __group) of different groups that share one of their rarest shingles."""
        threshold, shingle = self.threshold, self.shingle
        texts = self.texts(nodes, "__group")

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            total = np.zeros(1 << ORDER_BITS, np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    codes = np.concatenate(list(shingles_of([_unpack(z) for z in batch.column(0).slice(a, 256).to_pylist()], shingle)))
                    for at in _counters(codes):
                        np.add.at(total, at, 1)
            at = np.flatnonzero(total)
            yield at, total[at]

        often = packed_counts(texts.select("__z"), counted, 1 << ORDER_BITS)
        shared = texts.sparkSession.sparkContext.broadcast(np.minimum(often, (1 << 31) - 1).astype(np.int32))  # 2**ORDER_BITS counters

        def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = shared.value
            for batch in batches:
                node, group = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                out: list[list] = [[], [], [], [], []]
                packed = batch.column(1).to_pylist()
                every = (codes for a in range(0, len(packed), 256) for codes in shingles_of([_unpack(z) for z in packed[a : a + 256]], shingle))
                for i, codes in enumerate(every):
                    n = len(codes)
                    if not n:
                        continue
                    one, two = _counters(codes)
                    many = np.minimum(often[one], often[two])
                    order = np.lexsort((codes, many))
                    outer, inner = n - math.ceil(threshold * n - 1e-9) + 1, n - math.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1
                    first = order[:outer]
                    place = np.flatnonzero(many[first] > 1)  # a shingle counted once is in no other node
                    for k, values in enumerate((codes[first[place]].astype(np.int64), np.full(len(place), node[i]), np.full(len(place), group[i]), np.full(len(place), n, np.int32), place < inner)):
                        out[k].append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["__shingle", "__node", "__group", "__n", "__inner"])

        rows = table(texts.select("__node", "__z", "__group").mapInArrow(rarest, "__shingle bigint, __node bigint, __group bigint, __n int, __inner boolean"), "rarest")
        release(texts)
        mixed = rows.groupBy("__shingle").agg(F.min("__group").alias("lo"), F.max("__group").alias("hi")).where("lo < hi").select("__shingle")
        rows = rows.join(mixed, "__shingle", "left_semi")
        groups = rows.select("__shingle", "__group").distinct()
        # groups that meet over a shingle, and then only their nodes: nodes of one group never meet
        met = groups.select("__shingle", F.col("__group").alias("__ga")).join(groups.select("__shingle", F.col("__group").alias("__gb")), "__shingle").where("__ga != __gb")
        small = rows.where("__inner").select("__shingle", F.col("__group").alias("__ga"), F.col("__node").alias("__small"), F.col("__n").alias("__na"))
        large = rows.select("__shingle", F.col("__group").alias("__gb"), F.col("__node").alias("__large"), F.col("__n").alias("__nb"))
        pairs = small.join(met, ["__shingle", "__ga"]).join(large, ["__shingle", "__gb"]).where((F.col("__na") <= F.col("__nb")) & (F.col("__na") >= F.lit(threshold) * F.col("__nb") - 1e-9))
        return pairs.select(F.least("__small", "__large").alias("__a"), F.greatest("__small", "__large").alias("__b")).distinct()

    def verify(self, pairs: DataFrame, signed: DataFrame) -> DataFrame:
        """The pairs (__a, __b) that are near duplicates, with their __similarity."""
        threshold, miss, batch, shingle = self.threshold, self.miss, self.batch, self.shingle

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    sig = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(b.num_rows, -1) for k in (2, 3)]
                    live = survivors(sig[0], sig[1], threshold, miss, batch)
                    yield b.select(["__a", "__b"]).take(pa.array(live))

        first = signed.select(F.col("__node").alias("__a"), F.col("__sig").alias("__sa"))
        second = signed.select(F.col("__node").alias("__b"), F.col("__sig").alias("__sb"))
        kept = table(pairs.join(first, "__a").join(second, "__b").select("__a", "__b", "__sa", "__sb").mapInArrow(prune, "__a bigint, __b bigint"), "kept")
        texts = self.texts(kept.select(F.col("__a").alias("__node")).union(kept.select(F.col("__b").alias("__node"))).distinct())

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: dict[int, np.ndarray] = {}

            def shingles(node: int, z: bytes) -> np.ndarray:
                if node not in last:
                    if len(last) > 64:
                        last.clear()
                    last[node] = next(shingles_of([_unpack(z)], shingle))
                return last[node]

            for b in batches:
                ids = [b.column(k).to_pylist() for k in range(4)]
                s = np.array([jaccard(shingles(i, x), shingles(j, y)) for i, j, x, y in zip(*ids, strict=True)], float)
                ok = np.flatnonzero(s >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(s[ok])], names=["__a", "__b", "__similarity"])

        za = texts.select(F.col("__node").alias("__a"), F.col("__z").alias("__za"))
        zb = texts.select(F.col("__node").alias("__b"), F.col("__z").alias("__zb"))
        both = kept.join(zb, "__b").join(za, "__a").select("__a", "__b", "__za", "__zb")
        out = table(both.mapInArrow(exact, "__a bigint, __b bigint, __similarity double"), "edges")
        release(kept, texts)
        return out

    def members(self) -> DataFrame:
        """(__doc, __node, __group, __keep_doc, __keep_node, __many) of the rows of groups of two rows at least."""
        grouped = self.rows.join(self.labels, "__node", "left").withColumn("__group", F.coalesce("__group", "__node"))
        best = grouped.groupBy("__group").agg(F.min(F.struct(F.col("__doc").isNull().alias("n"), F.col("__doc").alias("d"), F.col("__node").alias("k"))).alias("m"), F.count(F.lit(1)).alias("__many")).where("__many > 1")
        return grouped.join(best, "__group").select("__doc", "__node", "__group", F.col("m.d").alias("__keep_doc"), F.col("m.k").alias("__keep_node"), "__many")

    def pairs(self) -> DataFrame:
        """(doc_id, duplicate_of, group_rows): each row that goes, with the row of its group that stays."""
        m = self.members()
        goes = ~(m["__doc"].eqNullSafe(m["__keep_doc"]) & (m["__node"] == m["__keep_node"]))
        return m.where(goes).select(F.col("__doc").alias("doc_id"), F.col("__keep_doc").alias("duplicate_of"), F.col("__many").alias("group_rows"))

    def kept(self) -> DataFrame:
        """The rows of docs that stay: one of each group, and all that are in none."""
        m = self.members()
        goes = m.where(~(m["__doc"].eqNullSafe(m["__keep_doc"]) & (m["__node"] == m["__keep_node"]))).select("__doc", "__node").distinct()
        node = free(self.docs, "__node")
        docs = self._keyed(self.docs, self.text, node)
        goes = goes.select(F.col("__doc").alias("__gone"), F.col("__node").alias("__gone_node"))
        same = (docs[node] == goes["__gone_node"]) & field(docs, self.key).eqNullSafe(goes["__gone"]) & field(docs, self.text).isNotNull()
        stay = docs.join(goes, same, "left_anti")
        again = table(self.rows.groupBy("__doc", "__node").count().where("count > 1").select(F.col("__doc").alias("__gone"), F.col("__node").alias("__gone_node")), "again")
        if not again.isEmpty():  # rows that repeat id and text
            same = (stay[node] == again["__gone_node"]) & field(stay, self.key).eqNullSafe(again["__gone"]) & field(stay, self.text).isNotNull()
            stay = stay.join(again, same, "left_anti").unionAll(stay.join(again, same, "left_semi").dropDuplicates([node, self.key]))
        return stay.drop(node)


def components(edges: DataFrame) -> DataFrame:
    """(__node, __group) of the nodes of edges (__a, __b): each connected component under its least node.

    Rounds of hooking every component on the least neighbouring one, and of following labels to their own; as many as the logarithm of the longest path, about.
    """
    both = table(edges.select("__a", "__b").unionAll(edges.select(F.col("__b").alias("__a"), F.col("__a").alias("__b"))).distinct(), "edges")
    labels = table(both.groupBy(F.col("__a").alias("__node")).agg(F.least(F.min("__b"), F.first("__a")).alias("__group")), "labels")
    while True:
        of = labels.select(F.col("__node").alias("__b"), F.col("__group").alias("__gb"))
        own = labels.select(F.col("__node").alias("__a"), F.col("__group").alias("__ga"))
        near = both.join(of, "__b").join(own, "__a")
        hooks = table(near.where("__gb < __ga").groupBy(F.col("__ga").alias("__group")).agg(F.min("__gb").alias("__to")), "hooks")
        if hooks.isEmpty():
            release(both, hooks)
            return labels
        moved = labels.join(hooks, "__group", "left").select("__node", F.coalesce("__to", "__group").alias("__group"))
        up = moved.select(F.col("__node").alias("__group"), F.col("__group").alias("__up"))
        labels, old = table(moved.join(up, "__group", "left").select("__node", F.coalesce("__up", "__group").alias("__group")), "labels"), labels
        release(hooks, old)

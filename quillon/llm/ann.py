"""Nearest neighbours by additive quantisation, inverted lists and exact reranking.

A vector is approximated by a sum of one full-dimensional codeword from each of BOOKS
codebooks, trained on residuals (k-means, level by level) of a bounded sample of the
vectors (SAMPLE rows, SAMPLE_BYTES); encoding is a beam search over the levels, and every
vector is encoded. It keeps its codes and the squared norm of its approximation, in the
list of its first codeword (of its first two from LISTS_OF_TWO vectors on).

A query probes the lists with the nearest words. In a list, lookup tables of its products
with all codewords give the approximate distances to all codes; those within a margin of
the exact distance of the k-th of them are ranked by exact distance. How many lists are probed,
and the margin, are the least with which held-out queries, compared with all vectors,
keep a share of recall of their exact neighbours.

A list lies in parts of PART vectors, about, one row each; the queries that probe a list
lie in chunks of ASKED, about, and every chunk visits every part of its list: a list that
holds a third of all vectors is so many rows. Parts and chunks meet in a join, and each
pair gives a query its k best at most. Vectors of each length are an index of their own;
lengths of at most EXACT vectors are compared exactly.

Ids are integers; other types are refused. Null ids, null vectors and those with null,
NaN or infinite elements have no neighbours and are none. A row is not its own
neighbour, but an equal row is. Equal distances: the smaller id first, also where more
rows than k are equal. Fewer than k others: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, smallest, table

BOOKS, WORDS, BEAM = 16, 256, 4
#: The most vectors, and bytes of them, to train codebooks on; queries to set probes and margin by.
SAMPLE, SAMPLE_BYTES, HELD_OUT = 65_536, 1 << 26, 128
#: Share of the exact neighbours that is kept.
RECALL = 0.97
#: Vectors that are encoded together at most; vectors in a part of a list, about, and bytes of them.
BLOB, PART, PART_BYTES = 4096, 65_536, 1 << 24
#: Queries in a chunk, about.
ASKED = 1024
#: Vectors from which on lists are those of two codewords; vectors of one length that are compared exactly.
LISTS_OF_TWO, EXACT = 4_000_000, 1024


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, x) if len(x) < 4096 else _add(total, near, x)
        size = np.bincount(near, minlength=k)
        full = size > 0
        centre[full] = total[full] / size[full, None]
        empty = np.flatnonzero(~full)
        centre[empty] = x[rng.choice(len(x), len(empty))]
    return centre


def _add(total: np.ndarray, near: np.ndarray, x: np.ndarray) -> None:
    order = np.argsort(near, kind="stable")
    values, first = np.unique(near[order], return_index=True)
    total[values] = np.add.reduceat(x[order], first, axis=0)


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    norm = (centre * centre).sum(1)
    return np.concatenate([(norm - 2 * x[a : a + 4096] @ centre.T).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Quantiser:
    """Codebooks (books, words, dimensions)."""

    books: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> Quantiser:
        rng = np.random.default_rng(seed)
        rest, out = x.astype(np.float32).copy(), []
        for _ in range(books):
            centre = _kmeans(rest, words, rng)
            rest -= centre[_nearest(rest, centre)]
            out.append(centre)
        return cls(np.stack(out))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, books) and squared norms of the approximations."""
        m, k, d = self.books.shape
        flat = self.books.reshape(m * k, d)
        cross = flat @ flat.T
        norm = np.einsum("ij,ij->i", flat, flat)
        codes, norms = np.empty((len(x), m), np.uint8), np.empty(len(x), np.float32)
        for a in range(0, len(x), 512):
            part = x[a : a + 512].astype(np.float32)
            n = len(part)
            dot = part @ flat.T
            cost, chosen = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int64)
            for level in range(m):
                own = slice(level * k, (level + 1) * k)
                step = (norm[own] - 2 * dot[:, own])[:, None, :] + cost[:, :, None]
                for j in range(level):
                    step = step + 2 * cross[chosen[:, :, j] + j * k, own]
                step = step.reshape(n, -1)
                width = min(beam, step.shape[1])
                best = np.argpartition(step, width - 1, axis=1)[:, :width]
                cost = np.take_along_axis(step, best, 1)
                chosen = np.concatenate([np.take_along_axis(chosen, (best // k)[:, :, None], 1), (best % k)[:, :, None]], axis=2)
            pick = chosen[np.arange(n), cost.argmin(1)]
            codes[a : a + n] = pick
            sums = self.decode(pick)
            norms[a : a + n] = np.einsum("ij,ij->i", sums, sums)
        return codes, norms

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.books.shape[2]), np.float32)
        for j in range(self.books.shape[0]):
            out += self.books[j][codes[:, j]]
        return out

    def approximate(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate squared distances less the queries' norms (codes, queries), from lookup tables."""
        out = np.repeat(norms[:, None], len(queries), axis=1)
        for j in range(self.books.shape[0]):
            lookup = np.ascontiguousarray(-2 * (self.books[j] @ queries.T))
            out += lookup[codes[:, j]]
        return out


    def lists(self, two: bool) -> np.ndarray:
        """The words of the lists."""
        return (self.books[0][:, None] + self.books[1][None]).reshape(-1, self.books.shape[2]) if two else self.books[0]

    def list_of(self, codes: np.ndarray, two: bool) -> np.ndarray:
        return codes[:, 0].astype(np.int64) * self.books.shape[1] + codes[:, 1] if two else codes[:, 0].astype(np.int64)


def exact_distances(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances, row by row."""
    d = vectors.astype(np.float64) - queries.astype(np.float64)
    return np.einsum("ij,ij->i", d, d)


def nearest_of(groups: np.ndarray, distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the k nearest of their group, ordered by group, distance and id."""
    order = np.lexsort((ids, distances, groups))
    own = groups[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    place = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
    return order[place < k]


def rank(queries: np.ndarray, quantiser: Quantiser, codes: np.ndarray, norms: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, margin: float, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and squared distances of the k nearest rows of each query, by query and rank; skip: the query's own row, or -1."""
    out: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, len(queries), 128):
        q, own = queries[a : a + 128], skip[a : a + 128]
        near = quantiser.approximate(q, codes, norms) + np.einsum("ij,ij->i", q, q)[None]
        has = np.flatnonzero(own >= 0)
        near[own[has], has] = np.inf
        lead = np.argpartition(near, k - 1, axis=0)[:k] if k < len(near) else np.tile(np.arange(len(near))[:, None], (1, len(q)))
        exact = np.stack([exact_distances(vectors[row], q) for row in lead])
        exact[np.isinf(np.take_along_axis(near, lead, 0))] = np.inf
        rows, who = np.nonzero((near <= exact.max(0)[None] + margin) & np.isfinite(near))
        for c in range(0, len(rows), 1 << 16):
            r, w = rows[c : c + (1 << 16)], who[c : c + (1 << 16)]
            for o, v in zip(out, (w + a, r, exact_distances(vectors[r], q[w])), strict=True):
                o.append(v)
    who, rows, distance = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
    top = nearest_of(who, distance, ids[rows], k)
    return who[top], rows[top], distance[top]


def neighbours(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 10, where: str | Column | None = None, recall: float = RECALL, sample: int = SAMPLE, books: int = BOOKS, words: int = WORDS, exact: int = EXACT, part: int = PART) -> DataFrame:
    """(key, rank, neighbour, distance): the k nearest other rows by Euclidean distance, of each row for which where holds (all without one)."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} isn't a column of integers")
    kind = df.schema[key].dataType.simpleString()
    asks = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    rows = df.select(field(df, key).cast("bigint").alias("__id"), field(df, vector).cast("array<float>").alias("__v"), asks.alias("__asks"))
    rows = rows.where("__id is not null and __v is not null and size(__v) > 0 and not exists(__v, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    counts = table(rows.groupBy(F.size("__v").alias("__d")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    few = counts.where(F.col("n") <= exact).select("__d")
    out = rows.withColumn("__d", F.size("__v")).join(few, "__d").groupBy("__d").applyInArrow(_compared(k), _FOUND)  # exact rows at most in a group
    for d, n in counts.where(F.col("n") > exact).collect():  # a row for each long list of vectors of one length
        out = out.unionAll(_searched(rows.where(F.size("__v") == d), d, n, k, recall, sample, books, words, part))
    return out.select(F.col("id").cast(kind).alias(key), "rank", "neighbour", "distance")


_FOUND = "id bigint, rank int, neighbour bigint, distance double"


def _found(who: np.ndarray, ids: np.ndarray, others: np.ndarray, distance: np.ndarray) -> dict[str, pa.Array]:
    first = np.flatnonzero(np.diff(who, prepend=-1))
    place = np.arange(len(who)) - np.repeat(first, np.diff(first, append=len(who)))
    return {"id": pa.array(ids[who].astype(np.int64)), "rank": pa.array((place + 1).astype(np.int32)), "neighbour": pa.array(others.astype(np.int64)), "distance": pa.array(np.sqrt(distance.astype(np.float64)))}


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)


def _compared(k: int):
    """The neighbours among a group of few vectors, exactly."""

    def run(group: pa.Table) -> pa.Table:
        x, ids, asks = _matrix(group.column("__v"), group.column("__d")[0].as_py()), group.column("__id").to_numpy(), group.column("__asks").to_numpy(zero_copy_only=False)
        who = np.flatnonzero(asks)
        pairs = np.repeat(who, len(x)), np.tile(np.arange(len(x)), len(who))
        pairs = [p[pairs[0] != pairs[1]] for p in pairs]
        distance = exact_distances(x[pairs[1]], x[pairs[0]])
        top = nearest_of(pairs[0], distance, ids[pairs[1]], k)
        return pa.table(_found(pairs[0][top], ids, ids[pairs[1][top]], distance[top]))

    return run


def _trained(rows: DataFrame, d: int, sample: int, books: int, words: int) -> tuple[Quantiser, np.ndarray]:
    """Codebooks, fitted in one task, and the held-out queries."""
    bounded = smallest(rows, min(sample, max(words, SAMPLE_BYTES // (4 * d))), "__id", "__v").select("__id", "__v")

    def one(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("__v"), d)[np.argsort(group.column("__id").to_numpy(), kind="stable")]
        held = x[:: max(1, len(x) // HELD_OUT)][:HELD_OUT]
        return pa.table({"books": [Quantiser.train(x, books, words).books.tobytes()], "held": [np.ascontiguousarray(held).tobytes()]})

    got = bounded.groupBy(F.lit(1).alias("__one")).applyInArrow(one, "books binary, held binary").first()
    return Quantiser(np.frombuffer(got.books, np.float32).reshape(books, words, d).copy()), np.frombuffer(got.held, np.float32).reshape(-1, d).copy()


def _nearest_lists(queries: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Squared distances of queries to the words of lists, less the queries' norms."""
    return np.einsum("ij,ij->i", lists, lists)[None] - 2 * queries @ lists.T


def _searched(rows: DataFrame, d: int, n: int, k: int, recall: float, sample: int, books: int, words: int, part: int) -> DataFrame:
    quantiser, held = _trained(rows, d, sample, books, words)
    two = n >= LISTS_OF_TWO

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs of a list each; up to 16 blobs' worth of vectors are held for that."""
        parts: list[tuple] = []
        held_rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, x, asks, codes, norms = (np.concatenate(p) for p in zip(*parts, strict=True))
            own = quantiser.list_of(codes, two)
            order = np.argsort(own, kind="stable")
            edges = np.flatnonzero(np.diff(own[order], prepend=-1))
            out: list[list] = [[] for _ in range(7)]
            for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                for c in range(a, b, BLOB):
                    r = order[c : min(c + BLOB, b)]
                    for o, v in zip(out, (int(own[r[0]]), len(r), ids[r].tobytes(), x[r].tobytes(), codes[r].tobytes(), norms[r].tobytes(), asks[r].tobytes()), strict=True):
                        o.append(v)
            kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["list", "n", "ids", "vectors", "codes", "norms", "asks"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOB):
                b = batch.slice(a, BLOB)
                x = _matrix(b.column(1), d)
                parts.append((b.column(0).to_numpy().astype(np.int64), x, b.column(2).to_numpy(zero_copy_only=False).astype(bool), *quantiser.encode(x)))
                held_rows += len(x)
                if held_rows >= 16 * BLOB:
                    yield from flush()
                    parts.clear()
                    held_rows = 0
        if parts:
            yield from flush()

    even = rows.select("__id", "__v", "__asks").repartition(max(8, -(-n // (16 * BLOB))))
    blobs = table(even.mapInArrow(encode, "list bigint, n bigint, ids binary, vectors binary, codes binary, norms binary, asks binary").withColumn("blob", F.monotonically_increasing_id()), "codes")
    probes, margin = _settings(blobs, quantiser, two, held, k, recall)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each list that they probe, in blobs."""
        lists = quantiser.lists(two)
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["asks"], bool))
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float32).reshape(-1, d)
                for a in range(0, len(at), BLOB // 8):
                    who = at[a : a + BLOB // 8]
                    far = _nearest_lists(x[who], lists)
                    near = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < len(lists) else np.tile(np.arange(len(lists)), (len(who), 1))
                    owner, target = np.repeat(np.arange(len(who)), near.shape[1]), near.ravel()
                    order = np.argsort(target, kind="stable")
                    edges = np.flatnonzero(np.diff(target[order], prepend=-1))
                    groups = [owner[order[b:c]] for b, c in zip(edges, np.append(edges[1:], len(order)), strict=True)]
                    columns = ([int(target[order[b]]) for b in edges], [row["blob"]] * len(groups), [len(g) for g in groups], [who[g].astype(np.int32).tobytes() for g in groups], [ids[who[g]].tobytes() for g in groups], [x[who[g]].tobytes() for g in groups])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["list", "blob", "n", "at", "names", "queries"])

    # a large list is spread over parts; all its queries visit each of them
    size = max(1, min(part, PART_BYTES // (4 * d)))
    parts = blobs.groupBy("list").agg(F.ceil(F.sum("n") / size).alias("parts"))  # a row for each list
    spread = blobs.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("blob"), F.col("parts")))
    packed = spread.select("list", "part", "blob", "n", "ids", "vectors", "codes", "norms").groupBy("list", "part").applyInArrow(_packed("blob", "n", "ids", "vectors", "codes", "norms"), "list bigint, part bigint, blobs binary, counts binary, ids binary, vectors binary, codes binary, norms binary")
    asked = table(blobs.select("blob", "ids", "vectors", "asks").mapInArrow(ask, "list bigint, blob bigint, n bigint, at binary, names binary, queries binary"), "asked")
    chunks = asked.groupBy("list").agg(F.ceil(F.sum("n") / ASKED).alias("chunks"))  # a row for each list
    chunked = asked.join(F.broadcast(chunks), "list").withColumn("part", F.pmod(F.xxhash64("blob"), F.col("chunks")))
    chunked = chunked.select("list", "part", "blob", "n", "at", "names", "queries").groupBy("list", "part").applyInArrow(_packed("blob", "n", "at", "names", "queries"), "list bigint, part bigint, from_blobs binary, asked binary, at binary, names binary, queries binary")
    visits = chunked.drop("part").join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - F.lit(1).cast("bigint")))).drop("parts")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, names, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["names"], np.int64), np.frombuffer(row["at"], np.int32)
                counts = np.frombuffer(row["counts"], np.int64)
                start = dict(zip(np.frombuffer(row["blobs"], np.int64).tolist(), (np.cumsum(counts) - counts).tolist(), strict=True))
                source = np.repeat(np.frombuffer(row["from_blobs"], np.int64), np.frombuffer(row["asked"], np.int64))
                begin = np.array([start.get(b, -1) for b in source.tolist()], np.int64)
                skip = np.where(begin >= 0, begin + at, -1)
                vectors, queries = (np.frombuffer(row[c], np.float32).reshape(-1, d) for c in ("vectors", "queries"))
                who, rows, distance = rank(queries, quantiser, np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["norms"], np.float32), vectors, ids, k, margin, skip)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (source[who], at[who], names[who], ids[rows], distance)], names=["b", "i", "id", "neighbour", "distance"])

    found = packed.join(visits, ["list", "part"]).mapInArrow(meet, "b bigint, i int, id bigint, neighbour bigint, distance double")
    best = found.groupBy("b", "i", "id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("n"))  # k for each part that a query visits
    return best.select("id", F.posexplode("n").alias("p", "x")).select("id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.neighbour").alias("neighbour"), F.sqrt("x.distance").alias("distance"))


def _packed(*columns: str):
    """One row of a group: the binary columns joined, the numbers as arrays."""

    def run(group: pa.Table) -> pa.Table:
        out = {"list": group.column("list")[:1], "part": group.column("part")[:1]}
        for c in columns:
            values = group.column(c)
            out[c] = pa.array([b"".join(values.to_pylist()) if pa.types.is_binary(values.type) else values.to_numpy().astype(np.int64).tobytes()], pa.binary())
        return pa.table(list(out.values()), names=[{"blob": names[0], "n": names[1]}.get(c, c) for c in out])

    names = ("from_blobs", "asked") if "queries" in columns else ("blobs", "counts")
    return run


def _settings(blobs: DataFrame, quantiser: Quantiser, two: bool, held: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """How many lists to probe, and the margin of approximate distances, for held-out queries against all vectors."""
    d, share = held.shape[1], 1 - (1 - recall) / 2
    order = np.argsort(np.argsort(_nearest_lists(held, quantiser.lists(two)), axis=1), axis=1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[np.ndarray]] = [[np.zeros(0)] * 3 for _ in held]
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["vectors"], np.float32).reshape(-1, d)
                exact = np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ held.T + np.einsum("ij,ij->i", held, held)[None]
                near = None
                for i in range(len(held)):
                    limit = best[i][0][-1] if len(best[i][0]) > k else np.inf
                    rows = np.flatnonzero(exact[:, i] < limit)
                    if not len(rows):
                        continue
                    if len(rows) > k + 1:
                        rows = rows[np.argpartition(exact[rows, i], k)[: k + 1]]
                    if near is None:
                        near = quantiser.approximate(held, np.frombuffer(row["codes"], np.uint8).reshape(len(x), -1), np.frombuffer(row["norms"], np.float32)) + np.einsum("ij,ij->i", held, held)[None]
                    made = (exact[rows, i], near[rows, i], np.full(len(rows), order[i, row["list"]]))
                    joined = [np.concatenate([a, b]) for a, b in zip(best[i], made, strict=True)]
                    top = np.argsort(joined[0], kind="stable")[: k + 1]
                    best[i] = [v[top] for v in joined]
        size = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held)), size).astype(np.int32)), *[pa.array(np.concatenate([b[j] for b in best]).astype(np.float64)) for j in range(3)]], names=["i", "exact", "near", "place"])

    def merge(group: pa.Table) -> pa.Table:
        exact, near, place = (group.column(c).to_numpy() for c in ("exact", "near", "place"))
        top = np.argsort(exact, kind="stable")[1 : k + 1]  # the nearest is the query itself
        return pa.table({"error": pa.array(near[top] - exact[top]), "place": pa.array(place[top])})

    got = blobs.select("list", "vectors", "codes", "norms").mapInArrow(run, "i int, exact double, near double, place double").groupBy("i").applyInArrow(merge, "error double, place double").toPandas()  # k for each held-out query
    return int(np.ceil(np.quantile(got["place"], share))) + 1, float(max(np.quantile(got["error"], share), 0.0))

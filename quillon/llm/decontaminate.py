"""Benchmark decontamination: passages of documents within an edit distance of an item.

Texts are sequences of words in lower case; an item of n words matches a passage at a
word edit distance of at most floor(ratio * n). Windows of items and of documents are
embedded by the random walk of Chakraborty, Goldenberg and Koucky: at each step the word
under the walk is written down, and a bit of its hash (another one at each step) says
whether the walk goes on to the next word. Two windows a few edits apart fall into step
again, so their embeddings agree in many places. A table samples SAMPLED steps of a walk
of its own; a window of a document is a candidate where the sampled words are those of a
window of an item, which has one at every place where it holds the sampled steps. The
windows are of the item's size class, the greatest of SIZES up to its length.

The number of tables follows from a calibration on all items: edited copies of each, at
the largest distance, half with edits at random places and half with evenly spread ones,
are looked up, and tables are added until in each size class a share RECALL of the copies
is found. Nearer passages are found more often, equal ones always.

Candidates are verified: at least n - k words of the item must occur in the text around
the window, and then the item is aligned exactly with that text. Nothing is sampled or
capped, so the result doesn't hang on how items are split into passes.

Characters of scripts without blanks are words of their own. Items of fewer words than
min_words match only passages equal to them, word by word. Null texts and those without
words have no passages, and such items match nothing. A repeated item matches under each
of its ids (of any type, null too); a repeated row has its matches again. Equal
distances: the first passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import arrays
from .common import append, field

RATIO, MIN_WORDS, RECALL = 0.2, 5, 0.999
#: Steps of the walks for items of so many words or more.
SIZES = (1, 2, 3, 4, 5, 7, 10, 14, 20)
#: Steps that a table samples.
SAMPLED = 4
#: Words of the items that one pass over the documents looks for, about; more take more passes.
WORDS_A_PASS = 400_000
#: Words of windows that are compared at a time.
WORDS_A_TIME = 1 << 18
#: Edited copies that the calibration looks up in each size class, at least.
COPIES = 1024
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def size_class(lengths: np.ndarray) -> np.ndarray:
    """The number of the greatest size up to each length."""
    return np.searchsorted(SIZES, lengths, "right") - 1


def most_edits(lengths: np.ndarray, ratio: float, min_words: int) -> np.ndarray:
    return np.where(lengths < min_words, 0, np.floor(ratio * lengths + 1e-9)).astype(np.int64)


def samples(table: int, size: int) -> np.ndarray:
    """The steps that a table samples of walks of a size; all of them if there are no more."""
    return np.sort(np.random.default_rng([table, size]).permutation(size)[:SAMPLED])


def keys(words: np.ndarray, table: int, sizes: list[int], inside: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size the key of the window at every word, and whether its sampled steps are before inside (an end for each word)."""
    n = len(words)
    words = np.append(words, np.uint64(0))  # walks end here
    turns = arrays.mix(words ^ arrays.mix(np.full(1, table + 1, np.uint64)))
    at = np.arange(n, dtype=np.int32)
    wanted = {size: set(samples(table, size).tolist()) for size in sizes}
    out = {size: (np.full(n, np.uint64(size)), np.ones(n, bool)) for size in sizes}
    for step in range(max(sizes, default=0)):
        own = [size for size in sizes if step in wanted[size]]
        if own:
            here = words[at]
            for size in own:
                code, ok = out[size]
                code *= _C[0]
                code += here
                if inside is not None:
                    ok &= at < inside
        at += ((turns[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int32)
        np.minimum(at, np.int32(n), out=at)
    return {size: (arrays.mix(code), ok) for size, (code, ok) in out.items()}


def shared(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """How many words of each item occur in its text."""
    own = np.arange(1, len(items) + 1, dtype=np.uint64)[:, None] * _C[2]
    inside = np.arange(items.shape[1])[None] < lengths[:, None]
    present = np.isin(arrays.mix(items ^ own)[inside], arrays.mix(texts ^ own)[np.arange(texts.shape[1])[None] < widths[:, None]])
    out = np.zeros(inside.shape, bool)
    out[inside] = present
    return out.sum(1)


def distances(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item to any run of words of its text, and where the first such run ends."""
    rows, width = texts.shape
    column = np.arange(width + 1)
    beyond = column[None] > widths[:, None]
    row = np.zeros((rows, width + 1), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for i in range(items.shape[1]):
        cut = np.empty_like(row)
        cut[:, 0] = i + 1
        cut[:, 1:] = np.minimum(row[:, :-1] + (items[:, i : i + 1] != texts), row[:, 1:] + 1)
        row = np.minimum.accumulate(cut - column, axis=1) + column
        over = lengths == i + 1
        if over.any():
            last = np.where(beyond[over], 1 << 20, row[over])
            end[over] = last.argmin(1)
            best[over] = last.min(1)
    return best, end


class Items:
    """What a pass looks for: the words of items, and the tables of their windows. tables: how many for each size class."""

    def __init__(self, ids: list, texts: list[str], ratio: float, min_words: int, tables: list[int]):
        words = arrays.Words(pa.array(texts, pa.string()), characters=True)
        kept = np.flatnonzero(words.counts)
        self.ids = [ids[i] for i in kept]
        self.lengths = words.counts[kept]
        self.edits = most_edits(self.lengths, ratio, min_words)
        self.flat = words.hashes  # texts without words have none
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        kind = size_class(self.lengths)
        self.tables: list[tuple[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]]] = []
        owner = np.repeat(np.arange(len(kept)), self.lengths)
        place = arrays.ragged_positions(np.zeros(len(kept), np.int64), self.lengths)
        present = sorted(set(kind.tolist()))
        for table in range(max([tables[c] for c in present], default=0)):
            sizes = [SIZES[c] for c in present if table < tables[c]]
            made = keys(self.flat, table, sizes, self.first[1:][owner])
            own = []
            for size in sizes:
                code, ok = made[size]
                ok = np.flatnonzero(ok & (SIZES_OF[kind[owner]] == size) & ((place == 0) | (self.edits[owner] > 0)))
                ok = ok[np.argsort(code[ok], kind="stable")]
                shift = max(40, 61 - max(len(ok), 1).bit_length())
                bits = np.zeros(1 << (64 - shift), bool)
                bits[code[ok] >> np.uint64(shift)] = True
                own.append((size, bits, code[ok], owner[ok].astype(np.int32), place[ok].astype(np.int32), shift))
            self.tables.append((table, own))

    def item(self, i: np.ndarray, width: int) -> np.ndarray:
        """The words of items in rows of a width, 0 after the last."""
        at = self.first[i][:, None] + np.arange(width)[None]
        return np.where(np.arange(width)[None] < self.lengths[i][:, None], self.flat[np.minimum(at, len(self.flat) - 1)], 0)

    def candidates(self, words: arrays.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, where the item would begin in it), each once."""
        found = []
        h = words.hashes
        for table, own in self.tables:
            made = keys(h, table, [t[0] for t in own]) if len(h) else {}
            for size, bits, code, item, place, shift in own:
                if not len(h) or not len(code):
                    continue
                mine = made[size][0]
                hits = np.flatnonzero(bits[mine >> np.uint64(shift)])
                lo, hi = np.searchsorted(code, mine[hits], "left"), np.searchsorted(code, mine[hits], "right")
                many = hi - lo
                row = arrays.ragged_positions(lo, many)
                at = np.repeat(hits, many)
                doc = np.searchsorted(words.offsets, at, "right") - 1
                found.append(np.stack([doc, item[row].astype(np.int64), at - place[row] - words.offsets[doc]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def find(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, word after the last) of the best passage for each text and item that match."""
        words = arrays.Words(column, characters=True)
        h, offsets = words.hashes, words.offsets
        doc, item, start = self.candidates(words)
        if not len(doc):
            return
        # candidates of an item that begin within its edits of each other are verified together
        k = self.edits[item]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] // (k[1:] + 1) != start[:-1] // (k[:-1] + 1))
        head = np.flatnonzero(new)
        end = np.append(head[1:], len(doc)) - 1
        doc, item, low, high = doc[head], item[head], start[head], start[end]
        order = np.argsort(self.lengths[item], kind="stable")
        doc, item, low, high = doc[order], item[order], low[order], high[order]
        n, k = self.lengths[item], self.edits[item]
        from_ = np.maximum(low - k, 0)
        to = np.minimum(high + n + k, words.counts[doc])
        some = to > from_
        doc, item, n, k, from_, to = (x[some] for x in (doc, item, n, k, from_, to))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        a = 0
        while a < len(doc):
            # rows of about one length: half as many at twice the length
            b = min(a + max(1, WORDS_A_TIME // int(n[a] + 3 * k[a])), int(np.searchsorted(n, 2 * n[a], "right")))
            s = np.arange(a, b)
            a = b
            text = self.window(h, offsets, doc[s], from_[s], (to - from_)[s], int((to - from_)[s].max()))
            can = shared(self.item(item[s], int(n[s].max())), n[s], text, (to - from_)[s]) >= n[s] - k[s]
            if not can.any():
                continue
            s, text = s[can], text[can]
            wanted = self.item(item[s], int(n[s].max()))
            d, end = distances(wanted, n[s], text, (to - from_)[s])
            ok = np.flatnonzero(d <= k[s])
            if not len(ok):
                continue
            back, size = wanted[ok], end[ok]
            flipped = np.zeros((len(ok), text.shape[1]), np.uint64)
            for r, i in enumerate(ok):
                flipped[r, : size[r]] = text[i, : size[r]][::-1]
            mirrored = np.zeros_like(back)
            for r, i in enumerate(ok):
                mirrored[r, : n[s][i]] = back[r, : n[s][i]][::-1]
            begin = self.starts(mirrored, n[s][ok], flipped, size, d[ok])
            for r, i in enumerate(ok):
                key = (int(doc[s][i]), int(item[s][i]))
                got = (int(d[i]), int(from_[s][i] + size[r] - begin[r]), int(from_[s][i] + size[r]))
                if key not in best or got < best[key]:
                    best[key] = got
        for (row, i), (d, a, b) in sorted(best.items()):
            yield row, i, d, a, b

    @staticmethod
    def starts(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray, widths: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Lengths of the shortest prefixes of texts at their distance from items (all of the prefix counts)."""
        width = texts.shape[1]
        column = np.arange(width + 1)
        row = np.broadcast_to(column, (len(items), width + 1)).astype(np.int32)
        out = np.zeros(len(items), np.int64)
        for i in range(items.shape[1]):
            cut = np.empty_like(row)
            cut[:, 0] = i + 1
            cut[:, 1:] = np.minimum(row[:, :-1] + (items[:, i : i + 1] != texts), row[:, 1:] + 1)
            row = np.minimum.accumulate(cut - column, axis=1) + column
            over = lengths == i + 1
            if over.any():
                out[over] = ((row[over] == distance[over][:, None]) & (column[None] <= widths[over][:, None])).argmax(1)
        return out

    @staticmethod
    def window(h: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Rows of size words of docs from start on; 0 beyond the text."""
        at = start[:, None] + np.arange(width)[None]
        ok = (at >= 0) & (at < np.diff(offsets)[doc][:, None]) & (np.arange(width)[None] < size[:, None])
        return np.where(ok, h[np.clip(at + offsets[doc][:, None], 0, max(len(h) - 1, 0))], 0)


SIZES_OF = np.array(SIZES)


def edited(words: np.ndarray, edits: int, even: bool, rng: np.random.Generator) -> np.ndarray:
    """A copy of an item with so many words replaced, left out or put in, at random or evenly spread places."""
    n = len(words)
    places = (np.arange(1, edits + 1) * n) // (edits + 1) if even else rng.integers(n, size=edits)
    out = list(words)
    for at, kind in zip(sorted(places.tolist(), reverse=True), rng.integers(3, size=edits), strict=True):
        out[at : at + (kind != 2)] = [rng.integers(1 << 63, dtype=np.uint64)] * int(kind != 1)
    return np.array(out, np.uint64)


def first_tables(texts: pa.Array, ratio: float, min_words: int, copies: dict[int, int], tables: int) -> np.ndarray:
    """(size classes, tables + 1): how many edited copies of items each table is the first to find, and how many none finds."""
    words = arrays.Words(texts, characters=True)
    out = np.zeros((len(SIZES), tables + 1), np.int64)
    kind, edits = size_class(words.counts), most_edits(words.counts, ratio, min_words)
    for c in sorted(set(kind[words.counts > 0].tolist())):
        own, other, of, many = [], [], [], 0
        for i in np.flatnonzero((kind == c) & (edits > 0)):
            item = words.hashes[words.offsets[i] : words.offsets[i + 1]]
            rng = np.random.default_rng(item[:4])
            for k in range(copies.get(c, 2)):
                own.append(item)
                other.append(edited(item, int(edits[i]), k % 2 == 1, rng))
                of.append(many)
                many += 1
        if not many:
            continue
        left, right = (np.repeat(np.arange(many), [len(x) for x in part]) for part in (own, other))
        own_words, other_words = np.concatenate(own), np.concatenate(other)
        ends = np.cumsum([len(x) for x in own])[left]
        first = np.full(many, tables)
        for table in range(tables - 1, -1, -1):
            code, ok = keys(own_words, table, [SIZES[c]], ends)[SIZES[c]]
            mine, _ = keys(other_words, table, [SIZES[c]])[SIZES[c]]
            salt = lambda x: arrays.mix(x.astype(np.uint64) + np.uint64(1))
            hit = np.isin(mine ^ salt(right), (code ^ salt(left))[ok])
            first[np.unique(right[hit])] = table
        out[c] = np.bincount(first, minlength=tables + 1)
    return out


def calibrate(items: DataFrame, ratio: float, min_words: int, recall: float) -> list[int]:
    """Tables that each size class needs, by looking up edited copies of all items (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SIZES), np.int64)
        for batch in batches:
            lengths = arrays.Words(batch.column(0), characters=True).counts
            total += np.bincount(size_class(lengths[(lengths > 0) & (most_edits(lengths, ratio, min_words) > 0)]), minlength=len(SIZES))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(SIZES), dtype=np.int32)), pa.array(total)], names=["c", "n"])

    many = {r.c: r.n for r in items.mapInArrow(count, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect() if r.n}
    copies = {c: 2 * math.ceil(COPIES / (2 * n)) for c, n in many.items()}
    need, tables = [1] * len(SIZES), 16
    while many:

        def first(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(SIZES), tables + 1), np.int64)
            for batch in batches:
                for a, b in arrays.slices(batch.column(0), 1 << 16):
                    total += first_tables(batch.column(0).slice(a, b - a), ratio, min_words, copies, tables)
            c, t = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(t.astype(np.int32)), pa.array(total[c, t])], names=["c", "t", "n"])

        got = np.zeros((len(SIZES), tables + 1), np.int64)
        for r in items.mapInArrow(first, "c int, t int, n bigint").groupBy("c", "t").agg(F.sum("n").alias("n")).collect():
            got[r.c, r.t] = r.n
        found = np.cumsum(got[:, :-1], axis=1) >= recall * got.sum(1)[:, None]
        for c in [c for c in many if found[c].any()]:
            need[c] = int(found[c].argmax()) + 1
            del many[c]
        tables *= 2
    return need


def passes(items: DataFrame, text: str, key: str, ratio: float, min_words: int, a_pass: int, recall: float) -> Iterator[Items]:
    """The items, by about a number of words a time; the tables are the same for all passes."""
    clean = items.select(field(items, key).alias("id"), field(items, text).alias("text")).where("text is not null")
    tables = calibrate(clean.select("text"), ratio, min_words, recall)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(arrays.Words(b.column(0), characters=True).counts.sum()) for b in batches)], pa.int64())], names=["n"])

    words = clean.select("text").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    many = max(1, math.ceil(words / a_pass))
    for k in range(many):
        part = clean if many == 1 else clean.where(F.pmod(F.xxhash64("text"), F.lit(many)) == k)
        rows = part.orderBy("id", "text").collect()  # a_pass words, about
        yield Items([r.id for r in rows], [r.text for r in rows], ratio, min_words, tables)


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", ratio: float = RATIO, min_words: int = MIN_WORDS, a_pass: int = WORDS_A_PASS, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word, end_word): the nearest passage for each document row and item that match."""
    ids = items.schema[item_key].dataType
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("item_id", ids), *T.StructType.fromDDL("edits int, item_words int, first_word int, end_word int").fields])
    kind = to_arrow_type(ids)
    out = None
    for wanted in passes(items, item_text, item_key, ratio, min_words, a_pass, recall):
        shared_items = docs.sparkSession.sparkContext.broadcast(wanted)  # a_pass words, about, and their windows in the tables

        def run(batches, shared_items=shared_items):
            wanted = shared_items.value
            for batch in batches:
                rows, got = [], []
                column = batch.column(1)
                for a, b in arrays.slices(column):
                    for row, i, d, first, end in wanted.find(column.slice(a, b - a)):
                        rows.append(a + row)
                        got.append((wanted.ids[i], d, int(wanted.lengths[i]), first, end))
                if rows:
                    values = list(zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(values[0], kind), *[pa.array(v, pa.int32()) for v in values[1:]]], names=schema.names)

        one = docs.select(field(docs, key), field(docs, text)).mapInArrow(run, schema)
        out = one if out is None else out.unionAll(one)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", ratio: float = RATIO, min_words: int = MIN_WORDS, a_pass: int = WORDS_A_PASS, recall: float = RECALL) -> DataFrame:
    """The rows of docs that have no passage of an item."""
    for wanted in passes(items, item_text, item_key, ratio, min_words, a_pass, recall):
        shared_items = docs.sparkSession.sparkContext.broadcast(wanted)  # a_pass words, about, and their windows in the tables

        def run(batch: pa.RecordBatch, shared_items=shared_items) -> tuple[pa.Array, list[pa.Array]]:
            wanted = shared_items.value
            column = batch.column(batch.schema.names.index(text))
            keep = np.ones(len(column), bool)
            for a, b in arrays.slices(column):
                for row, *_ in wanted.find(column.slice(a, b - a)):
                    keep[a + row] = False
            return pa.array(keep), []

        docs = append(docs, run, T.StructType([]))
    return docs

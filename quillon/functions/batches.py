"""Analyzed documents from Arrow batches of texts.

A batch's UTF-8 bytes are cut into tokens in a few numpy passes; equal tokens are found by
one dictionary for a slice of texts, whose words are sorted once, and a stable sort by
text and word brings every document's entries together with their positions. There is no
Python object for a token, and a slice bounds what is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21
#: A slice has so many rows at most, and an entry of a document counts as so many bytes.
SLICE_ROWS, ENTRY_BYTES = 1 << 14, 16

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
ENTRY = pa.struct([("term", pa.string()), ("tf", pa.int32()), ("pos", pa.list_(pa.int32()))])
DOC = pa.struct([("terms", pa.list_(ENTRY)), ("doclen", pa.int32()), ("has_pos", pa.bool_())])

#: What an analyzer makes of texts: a term for each place (null: none there), and how many places each text has.
Cutter = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of folded texts, one after the other, and how many each text has."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _INSIDE[raw]
    before, after = inside[:-2].copy(), inside[2:].copy()
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    before[edges] = False  # a token ends with its text
    after[edges - 1] = False
    inside = inside[1:-1]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    to = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=to[1:])
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(to.tobytes()), pa.py_buffer(raw[inside].tobytes()))
    return tokens, np.diff(np.searchsorted(starts, at))


def documents(tokens: pa.Array, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    """Documents of texts that have so many places each; a null token is a place without a term."""
    coded = tokens.dictionary_encode()
    words = coded.dictionary
    order = pc.sort_indices(words).to_numpy()  # by bytes
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = pc.fill_null(coded.indices, -1).to_numpy()
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(counts) - counts, counts)
    if coded.null_count:
        there = codes >= 0
        codes, owner, place = codes[there], owner[there], place[there]
    key = owner * max(len(words), 1) + rank[codes]
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    runs = np.append(first, len(key))
    entries = pa.StructArray.from_arrays(
        [words.take(pa.array(codes[by][first])), pa.array(np.diff(runs).astype(np.int32)), pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), pa.array(place[by].astype(np.int32)))],
        fields=list(ENTRY),
    )
    to = np.searchsorted(owner[by][first], np.arange(len(counts) + 1)).astype(np.int32)
    terms = pa.ListArray.from_arrays(pa.array(to), entries)
    return pa.StructArray.from_arrays([terms, pa.array(counts.astype(np.int32)), pa.array(np.ones(len(counts), bool))], fields=list(DOC), mask=pa.array(null))


def _sums(values: pa.Array) -> np.ndarray:
    """Running sums of the bytes that rows hold, of texts, binaries, documents or lists of these."""
    if pa.types.is_struct(values.type):
        return values.field("terms").offsets.to_numpy().astype(np.int64) * ENTRY_BYTES
    if pa.types.is_list(values.type):
        return _sums(values.values)[values.offsets.to_numpy()]
    return np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)


def _slices(values: pa.Array) -> Iterator[tuple[int, int]]:
    sums, row = _sums(values), 0
    while row < len(values):
        to = min(max(int(np.searchsorted(sums, sums[row] + SLICE_BYTES, "right")) - 1, row + 1), len(values), row + SLICE_ROWS)
        yield row, to
        row = to


def in_slices(of: Callable[..., pa.Array], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What of makes of slices of the columns, joined: its Python objects are those of one slice. The first column says where to cut."""
    parts = [of(*[c.slice(a, b - a) for c in columns]) for a, b in _slices(columns[0])]
    return pa.concat_arrays(parts) if len(parts) != 1 and parts else parts[0] if parts else pa.array([], kind)


def with_documents(df: DataFrame, name: str, cutter: Cutter = cut) -> DataFrame:
    """df with its last column, a text, replaced by the document of that text under a name."""
    kept = df.schema.fields[:-1]
    doc = T.StructField(name, T._parse_datatype_string("struct<terms: array<struct<term: string, tf: int, pos: array<int>>>, doclen: int, has_pos: boolean>"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate([*kept, doc])])  # a name may have dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b in _slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, b - a)
                texts = part.column(part.num_columns - 1)
                made = documents(*cutter(texts), texts.is_null().to_numpy(False))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=schema.names)

    made = df.toDF(*schema.names).mapInArrow(run, schema)
    return made.select(*[made[f"c{i}"].alias(f.name) for i, f in enumerate([*kept, doc])])

"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position its
output links give every piece that ends there, and each relaxes the best score of
that position (a single-pass Viterbi). The scores are those of the model file and
the result is the segmentation of the greatest sum, as in the library's unigram
mode. No piece of the public vocabularies has a space after another character, so
a text falls into chunks (blanks and the word after them) whose best segmentations
are independent; a worker keeps those of short chunks.

Ties go to the longest last piece. Null texts give null, empty ones no ids.
U+2581 in a text, which the library takes for a space, is spelled in byte pieces,
so that decoding gives back every text exactly.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays
from .common import append

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Chunks of up to so many characters are kept, so many of them at most; the rest is encoded anew each time.
KEPT_CHARS, KEPT_CHUNKS = 48, 400_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = 8 if wire == 1 else 4
            if wire == 2:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield number, value


def pieces(model: bytes) -> list[tuple[str, float, int]]:
    """Text, score and kind (1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte) of each piece of a model file."""
    out = []
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, 1)))
    return out


class Codec:
    """The tables of a model; encode and decode for single texts, decode_batch for ragged arrays of ids."""

    def __init__(self, model: bytes):
        self.pieces = pieces(model)
        self.byte = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(self.pieces) if kind == 6}
        unknown = next((i for i, p in enumerate(self.pieces) if p[2] == 2), 0)
        automaton, normal = ahocorasick.Automaton(), [p for p in self.pieces if p[2] in (1, 4)]
        for i, (text, score, kind) in enumerate(self.pieces):
            if kind in (1, 4):
                automaton.add_word(text, (len(text), score, i))
        automaton.make_automaton()
        self.automaton = automaton
        self.single = {p[0] for p in normal if len(p[0]) == 1}
        self.unknown_score = min((p[1] for p in normal), default=0.0) - 10
        apart = all(SPACE not in p[0].lstrip(SPACE) for p in normal)
        newline = all("\n" not in p[0] for p in normal)
        self.chunks = re.compile(" *[^ \n]+| +|\n+" if apart and newline else " *[^ ]+| +" if apart else r"(?s).+").findall
        self.unknown = unknown
        self.kept: dict[str, bytes] = {}
        spelled = [bytes([int(t[3:5], 16)]) if k == 6 else t.replace(SPACE, " ").encode() if k in (1, 4) else b"" for t, _, k in self.pieces]
        self.spelled_at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, char: str) -> list[int]:
        """Ids of a character that is no piece: its bytes, or the unknown piece where the model has none for them."""
        ids = [self.byte.get(b, self.unknown) for b in char.encode()]
        return ids if self.unknown not in ids else [self.unknown]

    def viterbi(self, chunk: str) -> bytes:
        """The best segmentation of a chunk, as little-endian 32-bit ids."""
        text = chunk.replace(SPACE, "\0▁").replace(" ", SPACE) if SPACE in chunk else chunk.replace(" ", SPACE)
        if SPACE in chunk:  # literal marks: byte pieces, between chunks
            out = []
            for part in re.split("(\0▁)", text):
                if part == "\0" + SPACE:
                    out.append(np.array(self.spell(SPACE), "<i4").tobytes())
                elif part:
                    out.append(self.path(part))
            return b"".join(out)
        return self.path(text)

    def path(self, text: str) -> bytes:
        n = len(text)
        low = float("-inf")
        best, back = [low] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        done, single, unknown = 0, self.single, self.unknown_score
        for end, (length, score, i) in self.automaton.iter(text):
            end += 1
            while done < end - 1:
                done += 1
                if text[done - 1] not in single and best[done - 1] + unknown > best[done]:
                    best[done], back[done] = best[done - 1] + unknown, (1, -1)
            total = best[end - length] + score
            if total > best[end]:
                best[end], back[end] = total, (length, i)
        while done < n:
            done += 1
            if text[done - 1] not in single and best[done - 1] + unknown > best[done]:
                best[done], back[done] = best[done - 1] + unknown, (1, -1)
        ids: list[int] = []
        at = n
        while at:
            length, i = back[at]
            if i < 0:
                ids.extend(reversed(self.spell(text[at - 1])))
            else:
                ids.append(i)
            at -= length
        ids.reverse()
        return np.array(ids, "<i4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        kept, out = self.kept, []
        for chunk in self.chunks(" " + text):
            ids = kept.get(chunk)
            if ids is None:
                ids = self.viterbi(chunk)
                if len(chunk) <= KEPT_CHARS:
                    if len(kept) >= KEPT_CHUNKS:
                        kept.clear()
                    kept[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        data, _ = self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))
        return data.tobytes().decode(errors="replace")

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of the texts of ragged ids; the blank put before a text goes."""
        starts = self.spelled_at[ids]
        lengths = self.spelled_at[ids + 1] - starts
        first = offsets[:-1][offsets[1:] > offsets[:-1]]
        lead = first[(lengths[first] > 0) & (self.spelled[np.minimum(starts[first], self.spelled.size - 1)] == 32)]
        starts[lead] += 1
        lengths[lead] -= 1
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.spelled[arrays.ragged_positions(starts, lengths)], total[offsets]


@lru_cache(maxsize=4)
def codec(model: bytes) -> Codec:
    return Codec(model)


def _model(path: str) -> bytes:
    return Path(path).read_bytes()


def encode(df: DataFrame, text: str = "text", model: str = MODEL, check: bool = True, drop_text: bool = False) -> DataFrame:
    """df with ids (array<int>), n_tokens and, if check, round_trip (whether the ids decode to the text).

    A null text has null in all three; an empty one has no ids. Columns of these names are replaced.
    """
    data = _model(model)

    def run(batch: pa.RecordBatch) -> tuple[None, list[pa.Array]]:
        tables, column = codec(data), batch.column(batch.schema.names.index(text))
        out = [tables.encode_bytes(x) if x is not None else b"" for x in column.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int64)
        ids = np.frombuffer(b"".join(out), "<i4")
        null = column.is_null()
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=null if column.null_count else None)
        columns = [lists, pa.array(np.diff(offsets).astype(np.int32), mask=null.to_numpy(False))]
        if check:
            same = np.ones(len(column), bool)
            raw, at = arrays.buffer(column)
            for a, b in arrays.slices(column):
                got, to = tables.decode_batch(ids[offsets[a] : offsets[b]].astype(np.int64), offsets[a : b + 1] - offsets[a])
                want = raw[at[a] : at[b]]
                if len(got) == len(want) and (to == at[a : b + 1] - at[a]).all() and (got == want).all():
                    continue
                same[a:b] = [got[to[k] : to[k + 1]].tobytes() == raw[at[a + k] : at[a + k + 1]].tobytes() for k in range(b - a)]
            columns.append(pa.array(same, mask=null.to_numpy(False)))
        return None, columns

    return append(df, run, "ids array<int>, n_tokens int" + ", round_trip boolean" * check, needs=[text], drop=[text] * drop_text)


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL, to: str = "decoded") -> DataFrame:
    """df with the text of a column of ids. Null ids give null, no ids the empty text, ids outside the vocabulary nothing, and bytes that are not UTF-8 U+FFFD."""
    data = _model(model)

    def run(batch: pa.RecordBatch) -> tuple[None, list[pa.Array]]:
        tables, out = codec(data), []
        for row in batch.column(batch.schema.names.index(ids)).to_pylist():
            out.append(None if row is None else tables.decode([i for i in row if i is not None and 0 <= i < len(tables.pieces)]))
        return None, [pa.array(out, pa.string())]

    return append(df, run, f"`{to}` string", needs=[ids])

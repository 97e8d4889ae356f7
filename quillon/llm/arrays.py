"""Ragged numpy arrays over the string buffers of Arrow columns.

The text operators work on whole batches: the UTF-8 bytes of all texts of a batch
lie in one buffer, words are spans in it, and hashes of words and of word n-grams
come from a few passes over the buffer, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes, so that temporary arrays stay small; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: Code points of scripts written without blanks, and of full-width punctuation and blanks; first and last of each range.
_UNSPACED = np.array([(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C), (0x3041, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF)])
_WIDE_MARKS = np.array([(0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0x3036, 0x3037), (0x303D, 0x3040), (0x30A0, 0x30A0), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)])
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n at least."""
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW[0], _POW[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about limit bytes each."""
    n = len(column)
    if n == 0:
        return
    offsets = string_offsets(column)
    row = 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        to = min(max(to, row + 1), n)
        yield row, to
        row = to


def string_offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = string_offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _within(codes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ranges[:, 0], codes, "right") - 1
    return (at >= 0) & (codes <= ranges[np.maximum(at, 0), 1])


def wide(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths in UTF-8 of the characters of scripts without blanks, and those of full-width punctuation."""
    at = np.flatnonzero(raw >= 0xE0)
    size = np.where(raw[at] >= 0xF0, 4, 3)
    last = max(len(raw) - 1, 0)
    codes = np.where(size == 4, raw[at] & 7, raw[at] & 15).astype(np.int64)
    for j in (1, 2):
        codes = codes << 6 | (raw[np.minimum(at + j, last)] & 63)
    codes = np.where(size == 4, codes << 6 | (raw[np.minimum(at + 3, last)] & 63), codes)
    one, mark = _within(codes, _UNSPACED), _within(codes, _WIDE_MARKS)
    return at[one], size[one], at[mark], size[mark]


class Words:
    """Words of a batch of texts: spans of ASCII letters, digits and bytes of 128 or more, in lower case.

    With characters, each character of a script without blanks (Chinese, Japanese, Thai and
    others) is a word, and full-width punctuation is in none.
    hashes has 64 bits for each word; offsets[i]:offsets[i + 1] are the words of text i.
    """

    def __init__(self, column: pa.Array, characters: bool = False):
        column = pc.fill_null(column, "") if column.null_count else column
        if len(column):
            raw, _ = buffer(column)
            if raw.size and raw.max() >= 128:
                column = pc.utf8_lower(column)
        raw, at = buffer(column)
        n = raw.size
        inside = _WORD[raw]
        one, one_size, mark, mark_size = wide(raw) if characters else [np.zeros(0, np.int64)] * 4
        inside[ragged_positions(mark, mark_size)] = False
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = at[1:-1]
            edges = edges[(edges > 0) & (edges < n)]
            before[edges] = False
            after[edges - 1] = False
        before[one] = after[one + one_size - 1] = False
        after[one[one > 0] - 1] = False
        next_ = one + one_size
        before[next_[next_ < n]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWER[raw] * power[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])
        self.offsets = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.offsets)
        self.raw, self.at = raw, at
        self._total, self._inverse = total, inverse

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first size bytes of the words that are longer, and the numbers of their texts."""
        longer = np.flatnonzero(self.ends - self.starts > size)
        start = self.starts[longer]
        texts = np.repeat(np.arange(len(self.counts)), self.counts)[longer]
        return mix(mix((self._total[start + size] - self._total[start]) * self._inverse[start]) + np.uint64(size)), texts

    def ngrams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of k words and their offsets by text; a text with fewer words has one, of all its words (none if it has no word)."""
        return ngrams(self.hashes, self.offsets, k)


def ngrams(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(offsets)
    many = np.maximum(counts - k + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(many)])
    at = ragged_positions(offsets[:-1], many)
    out = np.zeros(len(at), np.uint64)
    last = np.repeat(offsets[1:], many)
    short = bool((counts < k).any())
    for j in range(k):
        where = at + j
        if short:
            ok = where < last
            out = np.where(ok, mix(out * _ODD + hashes[np.minimum(where, max(len(hashes) - 1, 0))] + np.uint64(j)), out) if len(hashes) else out
        else:
            out = mix(out * _ODD + hashes[where] + np.uint64(j))
    return out, to


def ragged_positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over each span of offsets, 0 for empty spans; values may have more axes."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

"""Documents from and to other forms: the canonical text, a tsvector's text, bytes.

These are plain functions of one value, and Arrow functions over columns of them; within
the engine documents are structs and need none of this.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import _WORD, fold
from . import batches
from .text import DOC_TYPE

Doc = dict
_TERM = re.compile(r"'((?:[^'\\]|\\.)*)'", re.S)
_NUMBER = re.compile("[0-9]+")
_MOST = (1 << 31) - 1


class MalformedDocument(ValueError):
    pass


def document(entries: Iterable[tuple[str, list[int] | None, int]], doclen: int | None = None) -> Doc:
    """A document of (term, positions or None, tf); the length is the sum of frequencies unless it is given."""
    rows, last = [], None
    for term, pos, tf in entries:
        if tf < 1:
            raise MalformedDocument("invalid ftsdoc: term frequency must be at least 1")
        if last is not None and term.encode() <= last:
            raise MalformedDocument("invalid ftsdoc: terms must be sorted and distinct")
        if pos is not None and any(a >= b for a, b in zip(pos, pos[1:], strict=False)):
            raise MalformedDocument("invalid ftsdoc: positions must be ascending within a term")
        last = term.encode()
        rows.append({"term": term, "tf": tf, "pos": pos})
    return {"terms": rows, "doclen": sum(r["tf"] for r in rows) if doclen is None else doclen, "has_pos": all(r["pos"] is not None for r in rows)}


def analyze(text: str) -> Doc:
    """The built-in analyzer for a single text."""
    where: dict[str, list[int]] = {}
    words = [fold(m[0]) for m in _WORD.finditer(text)]
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i + 1)
    return document(((w, p, len(p)) for w, p in sorted(where.items(), key=lambda e: e[0].encode())), len(words))


def parse(text: str) -> Doc:
    """The document of a canonical text; a text that doesn't begin with a whole 'term':tf is analyzed as it is, a later fault is an error."""
    at, entries, placed = 0, [], False

    def fault(detail: str):
        raise MalformedDocument(f"malformed ftsdoc literal: {detail}")

    def number(what: str) -> int:
        nonlocal at
        m = _NUMBER.match(text, at)
        if not m:
            fault(f'expected a position at "{text[at:]}".')
        if int(m[0]) > _MOST:
            raise MalformedDocument(f"ftsdoc {what} out of range")
        at = m.end()
        return int(m[0])

    while True:
        while text[at : at + 1] == " ":
            at += 1
        if at >= len(text):
            break
        rest = text[at:]
        m = _TERM.match(text, at)
        digits = _NUMBER.match(text, m.end() + 1) if m and text[m.end() : m.end() + 1] == ":" else None
        if not digits:
            if not entries:
                return analyze(text)
            if rest[0] != "'":
                fault(f'expected a quoted term at "{rest}".')
            if not m:
                fault("trailing backslash in quoted term." if re.search(r"(?<!\\)(?:\\\\)*\\\Z", rest) else f'unterminated quoted term at "{rest}".')
            if text[m.end() : m.end() + 1] != ":":
                fault(f"expected ':' after term at \"{text[m.end() :]}\".")
            fault(f"expected term frequency after ':' at \"{text[m.end() + 1 :]}\".")
        at = m.end() + 1
        tf, pos = number("term frequency"), None
        if text[at : at + 1] == "@":
            placed, pos, at = True, [], at + 1
            for i in range(tf):
                if i:
                    if text[at : at + 1] != ",":
                        fault(f"expected {tf} positions for tf={tf}.")
                    at += 1
                pos.append(number("position"))
            if text[at : at + 1] == ",":
                fault(f"more than tf={tf} positions for a term.")
        elif placed:
            fault("positions must be given for every term or none.")
        entries.append((re.sub(r"\\(.)", r"\1", m[1], flags=re.S), pos, tf))
        if text[at : at + 1] not in (" ", ""):
            fault(f'unexpected trailing text at "{text[at:]}".')
    if not entries:
        return analyze(text)
    if placed and any(p is None for _, p, _ in entries):
        fault("positions must be given for every term or none.")
    return document(entries)


def from_tsvector(text: str) -> Doc:
    """From a tsvector's text ('cat':1A,4 'dog'): weights go; positions stay only if every lexeme has some."""
    rows = []
    for m in re.finditer(r"(?:'((?:[^'\\]|''|\\.)*)'|([^\s':]+))(?::([0-9A-Da-d,*]+))?", text):
        name = re.sub(r"''|\\(.)", lambda x: x[1] or "'", m[1]) if m[1] is not None else m[2]
        rows.append((name, sorted({int(x) for x in _NUMBER.findall(m[3] or "")})))
    rows.sort(key=lambda r: r[0].encode())
    placed = all(p for _, p in rows)
    return document((t, p if placed else None, len(p) or 1) for t, p in rows)


def to_bytes(doc: Doc) -> bytes:
    terms, placed = doc["terms"], bool(doc["has_pos"])
    out = [struct.pack(">HIIB", 3, len(terms), doc["doclen"], placed)]
    for t in terms:
        name = t["term"].encode()
        out += [struct.pack(">II", len(name), t["tf"]), name]
    if placed:
        out += [struct.pack(f">{t['tf']}I", *t["pos"]) for t in terms]
    return b"".join(out)


def from_bytes(data: bytes) -> Doc:
    """The document of to_bytes(), or of the older form without positions; its length is the sum of its frequencies."""
    try:
        (version,) = struct.unpack_from(">H", data)
        if version not in (2, 3):
            raise MalformedDocument(f"invalid ftsdoc: version {version}")
        many, _ = struct.unpack_from(">II", data, 2)
        at = 10
        placed = version == 3 and bool(data[at])
        at += version == 3
        if many > len(data) // 8:
            raise MalformedDocument("invalid ftsdoc: number of terms")
        rows = []
        for _ in range(many):
            size, tf = struct.unpack_from(">II", data, at)
            name = data[at + 8 : at + 8 + size]
            if len(name) != size or placed and 4 * tf > len(data):
                raise MalformedDocument("invalid ftsdoc: it ends too soon")
            rows.append([name.decode(), None, tf])
            at += 8 + size
        for r in rows if placed else ():
            r[1] = list(struct.unpack_from(f">{r[2]}I", data, at))
            at += 4 * r[2]
    except (struct.error, UnicodeDecodeError, IndexError) as e:
        raise MalformedDocument(f"invalid ftsdoc: {e}") from e
    if at != len(data):
        raise MalformedDocument("invalid ftsdoc: bytes are left over")
    return document(rows)


def _checked(entry: np.ndarray, term: pa.Array, tf: np.ndarray, pos: pa.Array, known: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Documents of the entries of texts that are known, and which of them stand the checks of document(); entry: the text that an entry is of."""
    many = len(known)
    placed = pos.is_valid().to_numpy(False)
    size = pc.fill_null(pos.value_lengths(), 0).to_numpy().astype(np.int64)
    at = pos.flatten().to_numpy(False).astype(np.int64)
    falls = np.zeros(len(at), bool)
    falls[1:] = at[1:] <= at[:-1]
    to = np.cumsum(size)
    starts = (to - size)[size > 0]
    falls[starts] = False
    wrong = (tf < 1) | (placed & (size != tf))
    wrong[np.repeat(np.arange(len(size)), size)[falls]] = True
    if len(entry) > 1:
        same = entry[1:] == entry[:-1]
        wrong[1:] |= same & ~pc.greater(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(False)  # by bytes
    count = np.bincount(entry, minlength=many)
    own = np.bincount(entry, placed, minlength=many)
    length = np.bincount(entry, tf, minlength=many)
    good = known & (np.bincount(entry, wrong, minlength=many) == 0) & ((own == 0) | (own == count)) & (length <= _MOST)
    entries = pa.StructArray.from_arrays([term, pa.array(tf.astype(np.int32)), pos], fields=list(batches.ENTRY))
    ends = np.zeros(many + 1, np.int32)
    np.cumsum(count, out=ends[1:])
    terms = pa.ListArray.from_arrays(pa.array(ends), entries)
    return pa.StructArray.from_arrays([terms, pa.array(np.minimum(length, _MOST).astype(np.int32)), pa.array(own == count)], fields=list(batches.DOC)), good


def _cut(texts: pa.Array, pattern: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The entries of texts that consist of them, with single blanks between: of which text, the groups of the pattern; and which texts these are."""
    parts = pc.split_pattern(texts, " ")
    entry = np.repeat(np.arange(len(texts)), pc.fill_null(parts.value_lengths(), 0).to_numpy())
    found = pc.extract_regex(parts.flatten(), pattern)
    known = texts.is_valid().to_numpy(False)
    known[entry[found.is_null().to_numpy(False)]] = False
    there = known[entry]
    return entry[there], found.filter(pa.array(there)), known


def _places(texts: pa.Array) -> pa.Array:
    """Lists of numbers from texts with commas; null for an empty one."""
    parts = pc.split_pattern(pc.if_else(pc.equal(texts, ""), None, texts), ",")
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(pc.fill_null(parts.value_lengths(), 0).to_numpy(), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), parts.flatten().cast(pa.int32()), mask=parts.is_null())


def _parsed_plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """parse() of texts without escapes, and for which of them this holds."""
    entry, found, known = _cut(texts, r"^'(?P<term>[^'\\]+)':(?P<tf>[0-9]+)(?:@(?P<pos>[0-9,]+))?$")
    term, tf, pos = found.flatten()
    return _checked(entry, term, tf.cast(pa.int32()).to_numpy(False).astype(np.int64), _places(pos), known)


def _tsvector_plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """from_tsvector() of texts of quoted lexemes without escapes, and for which of them this holds."""
    entry, found, known = _cut(texts, r"^'(?P<term>[^'\\]+)'(?::(?P<pos>[0-9]+[A-Da-d]?(?:,[0-9]+[A-Da-d]?)*))?$")
    term, pos = found.flatten()
    pos = _places(pc.replace_substring_regex(pos, "[A-Da-d]", ""))
    coded = term.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()  # by bytes
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.argsort(entry * max(len(order), 1) + rank[coded.indices.to_numpy()], kind="stable")
    term, pos = term.take(pa.array(by)), pos.take(pa.array(by))
    bare = np.bincount(entry, pos.is_null().to_numpy(False), minlength=len(texts)) > 0
    tf = np.maximum(pc.fill_null(pos.value_lengths(), 0).to_numpy().astype(np.int64), 1)
    if bare.any():
        pos = pc.if_else(pa.array(bare[entry]), pa.scalar(None, pos.type), pos)
    return _checked(entry, term, tf, pos, known)


def _ragged(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from each start on, one after the other, and where they end."""
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return raw[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _received_plain(data: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """from_bytes() of whole documents of the newer form, and for which of the values this holds."""
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].tolist()
    whole = data.buffers()[2]
    view = memoryview(whole) if whole is not None else memoryview(b"")
    two, known = struct.Struct(">II").unpack_from, data.is_valid().to_numpy(False)
    entry, starts, sizes, tfs, placed, first, total = [], [], [], [], [], [], []
    for i, (a, end) in enumerate(zip(offsets, offsets[1:], strict=False)):
        if not known[i]:
            continue
        known[i] = False
        if end - a < 11 or bytes(view[a : a + 2]) != b"\0\3":
            continue
        many, at, own, s, n, f = two(view, a + 2)[0], a + 11, view[a + 10] != 0, [], [], []
        for _ in range(many):
            if at + 8 > end:
                break
            size, tf = two(view, at)
            s.append(at + 8)
            n.append(size)
            f.append(tf)
            at += 8 + size
        places = sum(f) if own else 0
        if len(f) < many or at + 4 * places != end:
            continue
        known[i] = True
        entry.append((i, many))
        starts += s
        sizes += n
        tfs += f
        placed += [own] * many
        first.append(at)
        total.append(4 * places)
    raw = np.frombuffer(view, np.uint8)
    array = lambda x: np.array(x, np.int64)
    name, ends = _ragged(raw, array(starts), array(sizes))
    term = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(name)]).cast(pa.string())
    places = _ragged(raw, array(first), array(total))[0].view(">u4")
    if len(places) and places.max() > _MOST:
        raise pa.ArrowInvalid("a position out of range")
    tf, own = array(tfs), np.array(placed, bool)
    to = np.zeros(len(tf) + 1, np.int32)
    np.cumsum(np.where(own, tf, 0), out=to[1:])
    pos = pa.ListArray.from_arrays(pa.array(to), pa.array(places.astype(np.int32)), mask=pa.array(~own))
    return _checked(np.repeat(*array(entry).reshape(-1, 2).T), term, tf, pos, known)


def _struct_column(of: Callable[[object], Doc], plain: Callable[[pa.Array], tuple[pa.Array, np.ndarray]]) -> Callable[[Column], Column]:
    """Documents of a column's values, slice by slice: in arrays where plain can, else one at a time, which also says what is wrong."""

    def one(values: pa.Array) -> pa.Array:
        try:
            made, good = plain(values)
        except (pa.ArrowInvalid, OverflowError):
            made, good = None, np.zeros(len(values), bool)
        if good.all():
            return made
        rest = pa.array([None if v is None else of(v) for v in values.filter(pa.array(~good)).to_pylist()], batches.DOC)
        if made is None:
            return rest
        at = np.where(good, np.arange(len(good)), len(good) + np.cumsum(~good) - 1)
        return pa.concat_arrays([made, rest]).take(pa.array(at))

    @F.arrow_udf(DOC_TYPE)
    def made(values: pa.Array) -> pa.Array:
        return batches.in_slices(one, batches.DOC, values)

    return made


def parsed(text: Column) -> Column:
    """parse() over a column; a malformed text fails the query."""
    return _struct_column(parse, _parsed_plain)(text)


def tsvector(text: Column) -> Column:
    return _struct_column(from_tsvector, _tsvector_plain)(text)


def received(data: Column) -> Column:
    return _struct_column(from_bytes, _received_plain)(data)


def sent(doc: Column) -> Column:
    """to_bytes() by built-in functions: numbers as big-endian bytes."""
    number = lambda x: F.unhex(F.lpad(F.hex(x.cast("bigint")), 8, "0"))
    head = F.concat(F.unhex(F.lit("0003")), number(F.size(doc["terms"])), number(doc["doclen"]), F.when(doc["has_pos"], F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))))
    hexed = lambda b: F.hex(b)
    names = F.array_join(F.transform(doc["terms"], lambda t: hexed(F.concat(number(F.octet_length(t["term"])), number(t["tf"]), F.encode(t["term"], "UTF-8")))), "")
    places = F.when(doc["has_pos"], F.array_join(F.transform(doc["terms"], lambda t: F.array_join(F.transform(t["pos"], lambda p: F.lpad(F.hex(p.cast("bigint")), 8, "0")), "")), "")).otherwise("")
    return F.concat(head, F.unhex(names), F.unhex(places))

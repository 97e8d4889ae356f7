"""Functions over columns: in slices, and the same as for single values."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import batches, codec

WORDS = ["a", "b", "cé", "dd", "e", "zz", "日本"]


def canonical(doc):
    return " ".join(f"'{t['term']}':{t['tf']}" + ("@" + ",".join(map(str, t["pos"])) if t["pos"] is not None else "") for t in doc["terms"])


def outcome(of, value):
    try:
        return pa.array([of(value)], batches.DOC).to_pylist()[0]
    except codec.MalformedDocument:
        return "malformed"


def spoiled(rng, value, signs):
    if rng.random() < 0.5 or not value:
        return value
    at, new = rng.randrange(len(value)), rng.choice(signs)
    return value[:at] + rng.choice([new, new + value[at : at + 1], value[:0]]) + value[at + 1 :]


def test_documents_in_arrays_equal_those_of_values():
    rng, taken = random.Random(1), {}
    for _ in range(1500):
        doc = codec.analyze(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(8))))
        if rng.random() < 0.2:
            doc = doc | {"terms": [t | {"pos": None} for t in doc["terms"]], "has_pos": not doc["terms"]}
        vector = " ".join(f"'{w}'" + rng.choice([":1A", ":1,3", ":3,1", "", ":2b,4*", ":0"]) for w in rng.sample(WORDS, rng.randrange(5)))
        signs = ["'", "\\", ":", "@", ",", " ", "0", "19", "A", "é", "\n", "*"]
        for of, plain, value, kind in (
            (codec.parse, codec._parsed_plain, spoiled(rng, canonical(doc), signs), pa.string()),
            (codec.from_tsvector, codec._tsvector_plain, spoiled(rng, vector, signs), pa.string()),
            (codec.from_bytes, codec._received_plain, spoiled(rng, codec.to_bytes(doc), [b"\0", b"\1", b"a", b"\xff"]), pa.binary()),
        ):
            try:
                made, good = plain(pa.array([value[:0], value, None], kind).slice(1))
            except (pa.ArrowInvalid, OverflowError):
                continue
            assert not good[1]
            if good[0]:
                taken[of] = taken.get(of, 0) + 1
                assert made.to_pylist()[0] == outcome(of, value), value
    assert len(taken) == 3 and min(taken.values()) > 300


def test_rows_of_either_kind_keep_their_places(spark):
    texts = ["'a':1@1 'b':2@2,3", None, "'don\\'t':1@1", "", "plain words", "'b':1 'c':3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string").coalesce(1)
    got = [r.d and r.d.asDict(True) for r in df.select("doc_id", codec.parsed(F.col("t")).alias("d")).orderBy("doc_id").collect()]
    assert got == [None if t is None else codec.parse(t) for t in texts]
    with pytest.raises(Exception, match="sorted and distinct"):
        spark.createDataFrame([("'b':1 'a':1",)], "t string").select(codec.parsed(F.col("t"))).collect()


def test_python_objects_are_those_of_a_slice(monkeypatch):
    """A batch of many documents was unfolded as a whole."""
    monkeypatch.setattr(batches, "SLICE_BYTES", 1000)
    seen = []
    texts = pa.array([None if i % 7 == 3 else "word " * (i % 40) for i in range(300)], pa.string())

    def of(part):
        seen.append(sum(len(t or "") for t in part.to_pylist()))
        return part

    assert batches.in_slices(of, pa.string(), texts).equals(texts) and len(seen) > 20 and max(seen) <= 1000
    docs = batches.documents(*batches.cut(texts), texts.is_null().to_numpy(False))
    sizes = []
    assert batches.in_slices(lambda part: sizes.append(len(part)) or part, batches.DOC, docs.slice(5)).equals(docs.slice(5))
    assert sum(sizes) == 295 and len(sizes) > 1

"""What the operators share: shared storage, and Arrow functions that add columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import storage
from ..sources.storage import scratch as folder


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut. It goes when it is released, or when the program ends."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.quillon_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that no plan reads any more."""
    for t in tables:
        storage.delete(t.sparkSession, t.quillon_path)


def field(df: DataFrame, name: str):
    """The column of that very name; a dot in it is not a path."""
    return df["`" + name.replace("`", "``") + "`"]


def free(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, **names: str) -> DataFrame:
    """df with the named columns alone, under the names of the keywords: no other column can clash."""
    return df.select(*[field(df, name).alias(key) for key, name in names.items()])


def smallest(df: DataFrame, n: int, *names: str) -> DataFrame:
    """The n rows of df with the smallest hashes of the named columns, all if there are fewer.

    Hashes are evenly spread, so rows beyond a bound that a few times n fall under are left out where they lie; if
    copies of rows make too few fall under it, the bound is raised. What moves is a few times n rows at any size.
    """
    rows = df.select("*", F.xxhash64(*[field(df, x) for x in names]).alias("__hash"))
    many = df.count()
    share = min(1.0, 4 * n / max(many, 1))
    while True:
        part = rows if share >= 1 else rows.where(F.col("__hash") <= int(share * (1 << 64)) - (1 << 63))
        if share >= 1 or part.count() >= n:
            return part.orderBy("__hash").limit(n).drop("__hash")
        share *= 4


def packed_counts(df: DataFrame, counted: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], size: int) -> np.ndarray:
    """Sums over df of sparse counts (places, values) below size; size numbers at most come to the driver, in a few packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, n in counted(batches):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], names=["at", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype("<i4").tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy().astype("<i8").tobytes()], pa.binary())], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for r in df.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).mapInArrow(pack, "at binary, n binary").toLocalIterator():
        out[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<i8")
    return out


def append(df: DataFrame, function: Callable[[pa.RecordBatch], tuple[pa.Array | None, list[pa.Array]]], fields: str | T.StructType, needs: Iterable[str] = (), drop: Iterable[str] = ()) -> DataFrame:
    """df with further columns, made from each Arrow batch; function returns a mask of rows to keep (None: all) and the new columns.

    A column of df that has the name of a new one is replaced; those of drop are read but not returned.
    """
    new = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    taken = {f.name.lower() for f in new.fields} | {n.lower() for n in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    reads = [f.name for f in kept] + [n for n in needs if n.lower() in taken]
    names = [f.name for f in kept]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kept + new.fields)])  # a name may have dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns(reads)
            mask, columns = function(batch)
            out = pa.RecordBatch.from_arrays([batch.column(reads.index(n)) for n in names] + columns, names=schema.names)
            yield out if mask is None else out.filter(mask)

    made = df.select(*[field(df, n).alias(f"r{i}") for i, n in enumerate(reads)]).mapInArrow(run, schema)
    return made.select(*[made[f"c{i}"].alias(f.name) for i, f in enumerate(kept + new.fields)])

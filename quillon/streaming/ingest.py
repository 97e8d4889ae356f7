"""Streams of documents and of deletions into an index.

Each micro-batch is one insert (or one delete) under a name made of the stream's and the
batch's number: a batch that is delivered again changes nothing. Segments are flushed every
so many batches and merged in tiers. Late documents are inserts like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import Conflict, Index


def _again(spark: SparkSession, path: str, change, tries: int = 10) -> Index:
    """A change of the newest state, tried anew when another writer came first."""
    for _ in range(tries):
        try:
            return change(Index.open(spark, path))
        except Conflict:
            continue
    raise Conflict(f"{tries} changes of {path} in a row came too late")


def ingest(stream: DataFrame, path: str, checkpoint: str, name: str = "documents", key: str = "doc_id", text: str = "text", flush_every: int = 8, **trigger) -> StreamingQuery:
    """Starts a query that inserts every batch of stream; it is searched as soon as the batch is done."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        index = _again(spark, path, lambda i: i.insert(rows, key, text, name=f"{name}-{number}"))
        if len(index.manifest["pending"]) >= flush_every:
            _again(spark, path, lambda i: i.flush().compact())

    return stream.writeStream.queryName(f"quillon-{name}").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()


def expunge(stream: DataFrame, path: str, checkpoint: str, name: str = "deletions", key: str = "doc_id", **trigger) -> StreamingQuery:
    """Starts a query that deletes the documents a stream names, each batch once."""

    def batch(rows: DataFrame, number: int) -> None:
        _again(rows.sparkSession, path, lambda i: i.delete(rows, key, name=f"{name}-{number}"))

    return stream.writeStream.queryName(f"quillon-{name}").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()

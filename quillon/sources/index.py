"""The inverted index: segments of Parquet tables, and a manifest for each state of it.

A segment has docs (doc_id, doclen), postings (term, doc_id, tf, doclen, positions) and
dictionary (term, df, max_tf). Postings and dictionary lie in folders by bucket, a hash of
the term, and are sorted by term within a file, so that a lookup reads one folder and few
row groups, and a join on bucket and term reads the folders that it needs;
several files a bucket (shards by document) keep the postings of a common term in pieces,
the more the larger a segment is, so that what a task takes in doesn't grow with it.
Deleted documents are tables of their own (doc_id, seq): a delete holds for segments
older than it. Documents just inserted are pending segments: whole already, without
postings in the buckets, read by their texts' terms.

An id is one document: of the rows of an insert that repeat an id the one with the text of
the smallest hash counts, and an id that is there already is replaced.

A change writes tables under new names and then one manifest, which is created whole or
not at all: readers keep the state they opened, a change that breaks off leaves no trace,
and of two that race one fails with Conflict.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import analyze, column
from . import storage

FORMAT = 2
BUCKETS, SHARDS = 16, 1
#: A segment has a shard for so many tokens, or bytes of what it is made from, in all its buckets: were all in one bucket, a task would take them.
SHARD_TOKENS, SHARD_BYTES = 1 << 24, 1 << 27
#: Shards of postings for each piece of a bucket's dictionary.
DICTIONARY_SHARDS = 8
#: Delete tables of the same segments that are joined into one.
MOST_DELETES = 4
POSTINGS = "term string, doc_id bigint, tf int, doclen int, positions array<int>"


class Conflict(RuntimeError):
    """Another change came first; open the index again."""


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term if isinstance(term, Column) else F.lit(term)), F.lit(buckets)).cast("int")


def buckets_of(spark: SparkSession, terms: list[str], buckets: int) -> list[int]:
    """The buckets of terms, worked out on the driver where the library of the hash is installed."""
    try:
        from xxhash import xxh64_intdigest
    except ImportError:
        return sorted(set(spark.range(1).select(*[bucket_of(t, buckets).alias(f"b{i}") for i, t in enumerate(terms)]).first()))
    signed = (h - (1 << 64) if (h := xxh64_intdigest(t.encode(), 42)) >= 1 << 63 else h for t in terms)
    return sorted({h % buckets for h in signed})


def postings_of(docs: DataFrame, positions: bool = True) -> DataFrame:
    """Postings of analyzed documents (doc_id, doc), row by row."""
    rows = docs.select("doc_id", F.col("doc.doclen").alias("doclen"), F.explode("doc.terms").alias("t"))
    return rows.select(F.col("t.term").alias("term"), "doc_id", F.col("t.tf").alias("tf"), "doclen", (F.col("t.pos") if positions else F.lit(None).cast("array<int>")).alias("positions"))


@dataclass
class Index:
    """A state of an index. key and text name the columns of what is inserted."""

    spark: SparkSession
    path: str
    manifest: dict

    @classmethod
    def create(cls, spark: SparkSession, path: str, positions: bool = True, buckets: int = BUCKETS, shards: int = SHARDS, analyzer: str = "builtin") -> Index:
        """An empty index. shards: pieces of each bucket at least; larger segments get more."""
        index = cls(spark, path.rstrip("/"), {"format": FORMAT, "version": 0, "seq": 0, "positions": positions, "buckets": buckets, "shards": shards, "analyzer": analyzer, "segments": [], "pending": [], "deletes": []})
        if not storage.write_json(spark, index._manifest(0), index.manifest):
            raise Conflict(f"there is an index in {path}")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        path = path.rstrip("/")
        versions = [int(n[:-5]) for n in storage.names(spark, f"{path}/manifests") if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            raise FileNotFoundError(f"no index in {path}")
        manifest = storage.read_json(spark, f"{path}/manifests/{max(versions):08d}.json")
        if manifest.get("format") != FORMAT:
            raise ValueError(f"the index has format {manifest.get('format')}, this library reads {FORMAT}; build it again from its texts")
        return cls(spark, path, manifest)

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str = "doc_id", text: str = "text", **options) -> Index:
        """An index of all rows with a text, in one segment."""
        return cls.create(df.sparkSession, path, **options).insert(df, key, text).flush()

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:08d}.json"

    def commit(self, **changes) -> Index:
        new = {**self.manifest, **changes, "version": self.manifest["version"] + 1}
        if not storage.write_json(self.spark, self._manifest(new["version"]), new):
            raise Conflict(f"version {new['version']} of {self.path} is there already")
        return Index(self.spark, self.path, new)

    # --- tables

    def _read(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        out = None
        for p in parts:
            out = p if out is None else out.unionAll(p)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _live(self, df: DataFrame, seq: int) -> DataFrame:
        """df without the documents deleted after its segment was made."""
        for d in self.manifest["deletes"]:
            if d["seq"] > seq:
                df = df.join(self._read(d["name"], "doc_id bigint"), "doc_id", "left_anti").select(*df.columns)  # a join by name puts its column first
        return df

    def documents(self, pending: bool = True) -> DataFrame:
        """(doc_id, doclen) of all live documents, those without terms too."""
        parts = [self._live(self._read(f"{s['name']}/docs", "doc_id bigint, doclen int"), s["seq"]) for s in self.manifest["segments"]]
        if pending:
            parts += [self._live(self._read(p["name"], "doc_id bigint, doclen int"), p["seq"]) for p in self.manifest["pending"]]
        return self._union(parts, "doc_id bigint, doclen int")

    def _lookup(self, df: DataFrame, terms: list[str] | None) -> DataFrame:
        """The rows of terms in a table with buckets; all without terms."""
        if terms is None:
            return df
        return df.where(F.col("bucket").isin(buckets_of(self.spark, terms, self.manifest["buckets"])) & F.col("term").isin(terms)) if terms else df.where("false")

    def postings(self, terms: list[str] | None = None, pending: bool = True, live: bool = True, bucket: bool = False) -> DataFrame:
        """Postings; of the given terms by their buckets and by what files say about their terms. bucket: with that column."""
        parts = []
        for s in self.manifest["segments"]:
            df = self._lookup(self._read(f"{s['name']}/postings", POSTINGS + ", bucket int"), terms)
            parts.append(self._live(df, s["seq"]) if live else df)
        if pending:
            for p in self.manifest["pending"]:
                df = postings_of(self._read(p["name"], "doc_id bigint, doclen int, doc struct<terms: array<struct<term: string, tf: int, pos: array<int>>>, doclen: int>"), self.manifest["positions"])
                df = df.where(F.col("term").isin(terms) if terms else F.lit(False)) if terms is not None else df
                parts.append(self._live(df.withColumn("bucket", bucket_of(F.col("term"), self.manifest["buckets"])), p["seq"]))
        out = self._union(parts, POSTINGS + ", bucket int")
        return out if bucket else out.drop("bucket")

    def has_deletes(self) -> bool:
        return any(d["seq"] > s["seq"] for d in self.manifest["deletes"] for s in self.manifest["segments"] + self.manifest["pending"])

    def dictionary(self, pending: bool = True, terms: list[str] | None = None, bucket: bool = False) -> DataFrame:
        """(term, df, max_tf) of the live documents, or of the given terms alone. Segments' own dictionaries serve unless documents were deleted."""
        counted = (F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"))
        if self.has_deletes():
            out = self.postings(terms, pending, bucket=True).groupBy("bucket", "term").agg(*counted)
        else:
            parts = [self._lookup(self._read(f"{s['name']}/dictionary", "term string, df bigint, max_tf int, bucket int"), terms).select("bucket", "term", "df", "max_tf") for s in self.manifest["segments"]]
            if pending and self.manifest["pending"]:
                rest = Index(self.spark, self.path, {**self.manifest, "segments": []}).postings(terms, bucket=True)
                parts.append(rest.groupBy("bucket", "term").agg(*counted))
            out = self._union(parts, "bucket int, term string, df bigint, max_tf int")
            if len(parts) > 1:
                out = out.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"))
        return out if bucket else out.drop("bucket")

    def totals(self, pending: bool = True) -> DataFrame:
        """One row: ndocs, sumdoclen, avgdl. From the manifest, unless there are pending or deleted documents to count."""
        if self.has_deletes() or (pending and self.manifest["pending"]):
            rows = self.documents(pending).agg(F.count(F.lit(1)).cast("double").alias("ndocs"), F.coalesce(F.sum("doclen"), F.lit(0)).cast("double").alias("sumdoclen"))
        else:
            n, total = (float(sum(s[k] for s in self.manifest["segments"])) for k in ("ndocs", "sumdoclen"))
            rows = self.spark.range(1).select(F.lit(n).alias("ndocs"), F.lit(total).alias("sumdoclen"))
        return rows.select("ndocs", "sumdoclen", F.when(F.col("ndocs") > 0, F.col("sumdoclen") / F.col("ndocs")).otherwise(0.0).alias("avgdl"))

    def segments(self) -> int:
        return len(self.manifest["segments"])

    # --- changes

    def _analyze(self, df: DataFrame, key: str, text: str, folder: str) -> None:
        """Writes the analyzed documents of df's rows with an id and a text."""
        rows = df.select(column(df, key).cast("bigint").alias("doc_id"), column(df, text).alias("text")).where("doc_id is not null and text is not null")
        if self.manifest["analyzer"] == "builtin":
            made = analyze(rows, keep_text=False)
        else:
            from ..functions.english import analyze_config

            made = analyze_config(rows, self.manifest["analyzer"], keep_text=False)
        made.select("doc_id", F.col("doc.doclen").alias("doclen"), "doc").write.parquet(f"{self.path}/{folder}")

    def insert(self, df: DataFrame, key: str = "doc_id", text: str = "text", name: str | None = None) -> Index:
        """df's documents as a pending segment, which is searched at once; ids that are there already are replaced.

        A name that is there already changes nothing (a repeated batch).
        """
        if self._done(name):
            return self
        rows = df.select(column(df, key).cast("bigint").alias("doc_id"), column(df, text).alias("text")).where("doc_id is not null and text is not null")
        if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():  # ids alone move
            rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        folder, seq, deletes = f"pending-{uuid.uuid4().hex}", self.manifest["seq"] + 1, []
        if self.manifest["segments"] or self.manifest["pending"]:
            old = self.documents().select("doc_id").join(rows.select("doc_id"), "doc_id", "left_semi")
            if not old.isEmpty():
                gone = f"deletes-{uuid.uuid4().hex}"
                old.write.parquet(f"{self.path}/{gone}")
                deletes = [{"name": gone, "seq": seq}]
        self._analyze(rows, "doc_id", "text", folder)
        return self._commit_batch(name, seq=seq, pending=[*self.manifest["pending"], {"name": folder, "seq": seq}], deletes=self.manifest["deletes"] + deletes)

    def _done(self, name: str | None) -> bool:
        """Whether a batch was committed before: batches of a stream are numbered, and come in order."""
        if name is None:
            return False
        stream, _, number = name.rpartition("-")
        last = self.manifest.get("batches", {})
        return int(number) <= last.get(stream, -1) if number.isdigit() else name in last

    def _commit_batch(self, name: str | None, **changes) -> Index:
        """Commits; of each stream the highest number is kept, of other names the name."""
        if name is not None:
            stream, _, number = name.rpartition("-")
            changes["batches"] = self.manifest.get("batches", {}) | ({stream: int(number)} if number.isdigit() else {name: 0})
        return self.commit(**changes)

    def delete(self, ids: DataFrame, key: str = "doc_id", name: str | None = None) -> Index:
        """Deletes documents; the same id inserted later is another document. A name that is there already changes nothing.

        Delete tables that hold for the same segments are joined into one, from MOST_DELETES of them on.
        """
        if self._done(name):
            return self
        folder, seq = f"deletes-{uuid.uuid4().hex}", self.manifest["seq"] + 1
        ids.select(column(ids, key).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct().write.parquet(f"{self.path}/{folder}")
        deletes = [*self.manifest["deletes"], {"name": folder, "seq": seq}]
        made = sorted({x["seq"] for x in self.manifest["segments"] + self.manifest["pending"]})
        groups: dict[tuple, list[dict]] = {}
        for d in deletes:  # those that no segment lies between
            groups.setdefault(tuple(s for s in made if s < d["seq"]), []).append(d)
        merged = []
        for own in groups.values():
            if len(own) >= MOST_DELETES:
                one = f"deletes-{uuid.uuid4().hex}"
                self._union([self._read(d["name"], "doc_id bigint") for d in own], "doc_id bigint").distinct().write.parquet(f"{self.path}/{one}")
                own = [{"name": one, "seq": max(d["seq"] for d in own)}]
            merged += own
        return self._commit_batch(name, seq=seq, deletes=sorted(merged, key=lambda d: d["seq"]))

    def tidy(self, share: float = 0.25) -> tuple[Index, bool]:
        """What a clean-up after deletes does: flushes pending documents, and rewrites the segments of which more than a share is deleted."""
        index = self.flush()
        if not index.has_deletes():
            return index, index is not self
        chosen = []
        for s in index.manifest["segments"]:
            docs = index._read(f"{s['name']}/docs", "doc_id bigint, doclen int")
            if s["ndocs"] - index._live(docs, s["seq"]).count() > share * s["ndocs"]:
                chosen.append(s)
        return (index._rewrite(chosen), True) if chosen else (index, index is not self)

    def _shards(self, tokens: int) -> int:
        """Pieces of each bucket for a segment of all that self has."""
        size = sum(storage.size(self.spark, f"{self.path}/{x['name']}") for x in self.manifest["segments"] + self.manifest["pending"])
        return max(self.manifest["shards"], math.ceil(tokens / SHARD_TOKENS), math.ceil(size / SHARD_BYTES))

    def _segment(self, seq: int) -> dict:
        """Writes a segment of all that self has: one shuffle of the postings, to their bucket and shard; the dictionary is counted from what was written."""
        name, buckets = f"segment-{uuid.uuid4().hex}", self.manifest["buckets"]
        self.documents().write.parquet(f"{self.path}/{name}/docs")
        n, total = self._read(f"{name}/docs", "doc_id bigint, doclen int").agg(F.count(F.lit(1)), F.coalesce(F.sum("doclen"), F.lit(0))).first()
        shards = self._shards(total)
        pieces = math.ceil(shards / DICTIONARY_SHARDS)
        bucket, shard, piece = F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)), F.pmod(F.hash("term"), F.lit(pieces))
        placed = self.postings().select("term", "doc_id", "tf", "doclen", "positions", bucket_of(F.col("term"), buckets).alias("bucket"))
        placed.repartitionById(buckets * shards, (bucket * shards + shard).cast("int")).sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")
        written = self._read(f"{name}/postings", POSTINGS + ", bucket int")
        counted = written.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf")).select("term", "df", "max_tf", "bucket")
        counted.repartitionById(buckets * pieces, (bucket * pieces + piece).cast("int")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{name}/dictionary")
        return {"name": name, "seq": seq, "ndocs": n, "sumdoclen": total}

    def flush(self) -> Index:
        """Pending documents as a segment of their own; the index itself if there are none."""
        if not self.manifest["pending"]:
            return self
        only = Index(self.spark, self.path, {**self.manifest, "segments": []})
        seq = self.manifest["seq"]
        made = only._segment(seq)
        return self.commit(pending=[], segments=[*self.manifest["segments"], made] if made["ndocs"] else self.manifest["segments"])

    def _rewrite(self, chosen: list[dict]) -> Index:
        """One segment of several, without what was deleted from them."""
        part = Index(self.spark, self.path, {**self.manifest, "segments": chosen, "pending": []})
        # deletes newer than the merged segments are applied, those that newer segments need stay
        made = part._segment(self.manifest["seq"])
        rest = [s for s in self.manifest["segments"] if s not in chosen]
        kept = rest + ([made] if made["ndocs"] else [])
        deletes = [d for d in self.manifest["deletes"] if any(d["seq"] > s["seq"] for s in kept + self.manifest["pending"])]
        return self.commit(segments=kept, deletes=deletes)

    def merge(self) -> tuple[Index, bool]:
        """Everything in one segment, pending documents too; whether there was anything to do."""
        if not self.manifest["pending"] and len(self.manifest["segments"]) < 2 and not self.has_deletes():
            return self, False
        index = self.flush()
        if len(index.manifest["segments"]) > 1 or index.has_deletes():
            index = index._rewrite(index.manifest["segments"])
        return index, True

    def compact(self, most: int = 8, least: int = 4, factor: float = 3.0) -> Index:
        """Tiered merging: a run of segments, smallest first, each at most factor times the smallest, if there are least of them (two if there are more than most segments)."""
        order = sorted(self.manifest["segments"], key=lambda s: s["ndocs"])
        run = [s for s in order if s["ndocs"] <= factor * max(order[0]["ndocs"], 1)] if order else []
        if len(order) > most and len(run) < 2:
            run = order[:2]
        return self._rewrite(run) if len(run) >= (2 if len(order) > most else least) else self

    def vacuum(self) -> tuple[Index, bool]:
        """One segment, and no file that the newest state doesn't read; whether there was anything to do. Older states can't be read afterwards."""
        index, done = self.merge()
        used = {x["name"] for part in ("segments", "pending", "deletes") for x in index.manifest[part]} | {"manifests"}
        old = [n for n in storage.names(self.spark, self.path) if n not in used]
        for n in old:
            storage.delete(self.spark, f"{self.path}/{n}")
        versions = [n for n in storage.names(self.spark, f"{self.path}/manifests") if n != f"{index.manifest['version']:08d}.json"]
        for n in versions:
            storage.delete(self.spark, f"{self.path}/manifests/{n}")
        return index, done or bool(old)

    def reindex(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
        """Builds all anew from the texts, beside the old segments, and swaps them in one step."""
        folder = f"pending-{uuid.uuid4().hex}"
        self._analyze(df, key, text, folder)
        new = Index(self.spark, self.path, {**self.manifest, "segments": [], "deletes": [], "pending": [{"name": folder, "seq": self.manifest["seq"]}]})
        made = new._segment(self.manifest["seq"])
        return self.commit(segments=[made] if made["ndocs"] else [], pending=[], deletes=[])

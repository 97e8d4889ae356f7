"""Files in shared folders, by Hadoop's file systems, and small manifests in them."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, in local mode only, a folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes when the program ends."""
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove)
    _made.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session ended before
            return


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files in and under a path."""
    where, fs = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def read_json(spark: SparkSession, path: str) -> dict:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Creates the file whole or not at all; False if it is there already, which settles a race of two writers."""
    where, fs = _at(spark, path)
    if fs.exists(where):
        return False
    part, _ = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    if not fs.exists(where) and fs.rename(part, where):
        return True
    fs.delete(part, False)
    return False

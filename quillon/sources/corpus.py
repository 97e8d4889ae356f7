"""Corpora of texts: tables with an id and a text, from Parquet, CSV or tab-separated files.

Null texts are not indexed, as rows they stay. Only the two columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import column


def read_parquet(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return corpus(spark.read.parquet(path), key, text)


def read_csv(spark: SparkSession, path: str, schema: str, key: str = "id", text: str = "body", separator: str = ",", header: bool = False) -> DataFrame:
    """A file of rows; the schema is given, so that nothing is read twice."""
    return corpus(spark.read.schema(schema).csv(path, sep=separator, header=header, quote='"', escape='"', multiLine=True), key, text)


def read_tsv(spark: SparkSession, path: str, schema: str, key: str = "id", text: str = "body") -> DataFrame:
    return corpus(spark.read.schema(schema).csv(path, sep="\t", quote=""), key, text)


def corpus(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id bigint, text string) of any table with an id and a text."""
    return df.select(column(df, key).cast("bigint").alias("doc_id"), column(df, text).cast("string").alias("text"))


def concatenated(*texts: Column) -> Column:
    """One text of several columns, nulls left out: search over all of them."""
    return F.concat_ws(" ", *texts)

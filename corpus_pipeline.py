"""A corpus pipeline of five stages over documents; each reads what the one before it kept.

1. quality: documents whose probability of a good grade is under one half go.
2. near duplicates: one document of each group stays.
3. decontamination: documents with a passage of a benchmark item go.
4. secrets: a ledger scans the blobs, and the secrets it finds are replaced by the names of their rules.
5. tokens: SentencePiece ids of the texts, checked by decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, neardup, quality, secrets, sentencepiece
from quillon.llm.common import folder, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs if model is None else quality.score(docs, model, select=True)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(docs).kept()


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.Ledger(spark, folder(spark, "ledger")).scan(docs)
    return secrets.redact_found(docs, found).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs, drop_text=True)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("secrets", redacted), ("sentencepiece", tokens)]

#: The stages fit models, search by hashing and follow automata, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of sf_dir; stages are cut by tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

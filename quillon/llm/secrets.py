"""Secret scans with an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its text. The ledger holds the
(blob, rule, rule version) pairs already scanned and their findings. A scan meets the
ledger with hashes alone; only then one path of each blob that some rule has not seen
brings its text, which is read under those rules, and findings are joined back to every
path that holds the blob. Texts that were seen don't move and aren't read again. All of
it runs in the JVM: hashing, regular expressions (those of the rules, with a plain
substring test first where a rule names one) and joins.

Null texts are no blob and have no findings; empty texts are a blob without findings.
Repeated rows are repeated paths: each gets the findings. An empty table leaves the
ledger as it is. Findings carry the SHA-256 of the secret, never the secret.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from .common import field, free, release, table


@dataclass(frozen=True)
class Rule:
    """A regular expression (the common subset of Java's and RE2), its version, and a substring that every match has."""

    name: str
    version: int
    pattern: str
    literal: str | None = None

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


_KEY = "[A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?"

RULES = (
    Rule("aws_access_key", 1, "AKIA[0-9A-Z]{16}", "AKIA"),
    Rule("github_token", 1, "gh[pousr]_[0-9A-Za-z]{36}", "gh"),
    Rule("slack_token", 1, "xox[abprs]-[0-9A-Za-z-]{10,}", "xox"),
    Rule("google_api_key", 1, "AIza[0-9A-Za-z_-]{35}", "AIza"),
    Rule("stripe_key", 1, "sk_live_[0-9A-Za-z]{24,}", "sk_live_"),
    # up to the END line; without one, the header and the lines of base64 below it. Bounded repetitions: Java's stack, RE2's size
    Rule("private_key", 2, f"-----BEGIN {_KEY}-----(?:[^-]*(?:-{{1,4}}[^-]+){{0,16}}-----END {_KEY}-----|(?:[ \\t\\r\\n]{{1,4}}[0-9A-Za-z+/=]{{16,}}){{0,60}})", "PRIVATE KEY"),
    Rule("json_web_token", 1, "eyJ[0-9A-Za-z_-]{8,}[.]eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}", "eyJ"),
    Rule("assigned_secret", 2, "(?i:token|secret|password|passwd|api_key|apikey|access_key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?[0-9A-Za-z+/_=-]{16,}[\"']?"),
)


def _matches(text: Column, rule: Rule) -> Column:
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return found if rule.literal is None else F.when(F.contains(text, F.lit(rule.literal)), found).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def findings(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob_id, rule_id, rule_version, occurrence, secret_sha256) of blobs (__blob, __text, __todo: keys of the rules to apply, null for all)."""
    none = F.array().cast("array<string>")
    per_rule = [
        F.struct(F.lit(r.name).alias("rule_id"), F.lit(r.version).alias("rule_version"), F.when(F.coalesce(F.array_contains("__todo", r.key), F.lit(True)), _matches(F.col("__text"), r)).otherwise(none).alias("found")) for r in rules
    ]
    return (
        blobs.select("__blob", F.explode(F.filter(F.array(*per_rule), lambda x: F.size(x["found"]) > 0)).alias("r"))
        .select("__blob", "r.rule_id", "r.rule_version", F.posexplode("r.found").alias("at", "secret"))
        .select(F.col("__blob").alias("blob_id"), "rule_id", "rule_version", (F.col("at") + 1).alias("occurrence"), F.sha2("secret", 256).alias("secret_sha256"))
    )


def _blobs(versions: DataFrame, text: str) -> DataFrame:
    return versions.select(field(versions, text).alias("__text")).where("__text is not null").select("__text", blob_id(F.col("__text")).alias("__blob"))


def scan(versions: DataFrame, text: str = "text", path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of all versions, from an empty ledger: (path, blob_id, rule_id, rule_version, occurrence, secret_sha256).

    A blob's text crosses the network once for each task that has it, and is scanned once.
    """
    blobs = _blobs(versions, text).groupBy("__blob").agg(F.first("__text").alias("__text")).withColumn("__todo", F.lit(None).cast("array<string>"))
    return to_paths(versions, findings(blobs, rules), text, path)


def to_paths(versions: DataFrame, found: DataFrame, text: str, path: str) -> DataFrame:
    """found joined to every path of its blob."""
    paths = versions.select(field(versions, path).alias("__path"), field(versions, text).alias("__text")).select("__path", blob_id(F.col("__text")).alias("__blob"))
    out = paths.join(found, paths["__blob"] == found["blob_id"])
    return out.select(F.col("__path").alias(path), "blob_id", "rule_id", "rule_version", "occurrence", "secret_sha256")


class Ledger:
    """A ledger in a shared folder: scanned pairs and findings, each run a folder of its own.

    A run writes its findings before its pairs, so that a run that breaks off is done again; pairs are the mark of the end.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        if not storage.exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/*")

    def pairs(self) -> DataFrame:
        """(blob_id, rules, run): the pairs scanned so far, the rules of a blob as an array of rule@version."""
        return self._read("pairs", "blob_id string, rules array<string>, run string")

    def found(self) -> DataFrame:
        """Findings of the runs that ended."""
        all_found = self._read("findings", "blob_id string, rule_id string, rule_version int, occurrence int, secret_sha256 string, run string")
        return all_found.join(self.pairs().select("run").distinct(), "run", "left_semi").drop("run")

    def unseen(self, versions: DataFrame, text: str = "text", path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Blobs with a rule that has not seen them: (__blob, __at, __todo), the last the rules, __at the hash of one of the blob's paths."""
        seen = self.pairs().groupBy(F.col("blob_id").alias("__blob")).agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("__seen"))  # rule versions of one blob
        blobs = _paths(versions, text, path).groupBy("__blob").agg(F.min("__at").alias("__at"))
        todo = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("__seen", F.array().cast("array<string>")))
        return blobs.join(seen, "__blob", "left").withColumn("__todo", todo).where(F.size("__todo") > 0).drop("__seen")

    def texts(self, versions: DataFrame, todo: DataFrame, text: str = "text", path: str = "doc_id") -> DataFrame:
        """todo with the __text of its blobs, each from its one path (once for each row that repeats both)."""
        return _paths(versions, text, path, "__text").join(todo, ["__blob", "__at"])

    def scan(self, versions: DataFrame, text: str = "text", path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is unseen and gives the findings of all versions under these rules, old and new."""
        run = uuid.uuid4().hex
        todo = table(self.unseen(versions, text, path, rules), "unseen")
        if not todo.isEmpty():
            found = findings(self.texts(versions, todo, text, path), rules).distinct()
            found.withColumn("run", F.lit(run)).write.parquet(f"{self.path}/findings/{run}")
            todo.select(F.col("__blob").alias("blob_id"), F.col("__todo").alias("rules"), F.lit(run).alias("run")).write.parquet(f"{self.path}/pairs/{run}")
        release(todo)
        current = F.concat_ws("@", "rule_id", F.col("rule_version").cast("string")).isin([r.key for r in rules])
        return to_paths(versions, self.found().where(current), text, path)


def _paths(versions: DataFrame, text: str, path: str, *more: str) -> DataFrame:
    """(__blob, __at: a hash of the path, …) of the rows with a text."""
    rows = versions.select(field(versions, path).alias("__path"), field(versions, text).alias("__text")).where("__text is not null")
    return rows.select(blob_id(F.col("__text")).alias("__blob"), F.xxhash64("__path").alias("__at"), *more)


def redact_found(df: DataFrame, found: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """redact() of the rows whose blob has a finding (of scan(), under the same rules); the others stay as they are.

    The rows are those of redact(): a text without a finding has nothing to replace.
    """
    of, has = free(df, "__blob_of"), free(df, "__found")
    blobs = table(found.select(F.col("blob_id").alias("__blob_id")).distinct().withColumn(has, F.lit(True)), "found")
    marked = df.select("*", blob_id(field(df, text)).alias(of))
    marked = marked.join(blobs, marked[of] == blobs["__blob_id"], "left")
    marked = _replaced(marked.select(*[field(df, c) for c in df.columns], has), text, rules, has)
    return marked.select(*[field(marked, c).alias(c) for c in df.columns])


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with each secret in the text replaced by [its rule's name]. Null stays null; other columns are kept."""
    return _replaced(df, text, rules)


def _replaced(df: DataFrame, text: str, rules: tuple[Rule, ...], where: str | None = None) -> DataFrame:
    """redact() of the rows where a column is true, of all without one.

    Each rule is a projection of its own: as one expression each rule would hold all those before it three times.
    """
    for r in rules:
        value = field(df, text)
        out = F.regexp_replace(value, F.lit(r.pattern), F.lit(f"[{r.name}]"))
        if r.literal is not None:
            out = F.when(F.contains(value, F.lit(r.literal)), out).otherwise(value)
        df = df.withColumn(text, out if where is None else F.when(field(df, where), out).otherwise(value))
    return df


def scan_sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """scan() of a table with doc_id and text, in DuckDB's SQL."""
    one = [
        f"SELECT doc_id, sha256(text) AS blob_id, '{r.name}' AS rule_id, {r.version} AS rule_version, regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}') AS found FROM {table} WHERE text IS NOT NULL" for r in rules
    ]
    return f"WITH f AS ({' UNION ALL '.join(one)}), g AS (SELECT doc_id, blob_id, rule_id, rule_version, unnest(found) AS secret, generate_subscripts(found, 1) AS occurrence FROM f) SELECT doc_id, blob_id, rule_id, rule_version, CAST(occurrence AS INTEGER) AS occurrence, sha256(secret) AS secret_sha256 FROM g"

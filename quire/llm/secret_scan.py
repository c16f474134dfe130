"""Secret scans by a ledger of blobs.

Every text is addressed by its content. Only pairs of a blob and a rule's version that the ledger lacks are scanned,
each blob once whatever number of rows hold it; findings are joined back to all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import file_system, fresh, shared_dir, shuffles_removed
from quire.llm.spans import bare, by_start, count, listed, matches, none

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""

#: A key from its first line to its last, whatever stands between but another such line; where the last is lacking, the
#: lines of its body.
PRIVATE_KEY = (
    "-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----"
    "(?:[^-]*+(?:-[^-]++)*+-----END [A-Z0-9 ]*?PRIVATE KEY-----"
    r"|(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)"
)


@dataclass(frozen=True)
class Rule:
    """guard: whether a text can match at all (text, its lower case); passes: which matches count."""

    name: str
    version: int
    pattern: str
    guard: Callable[[Column, Column], Column]
    passes: Callable[[Column], Column] = lambda m: F.lit(True)

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def _any(words: list[str]) -> Callable[[Column, Column], Column]:
    def guard(text: Column, low: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    return guard


#: The first three are the base; their order is that of equal starts.
RULES = (
    Rule("assign", 1, ASSIGN, _any(["password", "passwd", "secret", "token", "apikey", "api_key"]), lambda m: F.length(F.regexp_extract(m, VALUE, 1)) >= 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", lambda t, low: F.contains(t, F.lit("AKIA")), lambda m: F.length(m) >= 20),
    Rule("hex", 1, "[0-9a-f]{24,}", lambda t, low: t.rlike("[0-9a-f]{24}")),
    Rule("private_key", 2, PRIVATE_KEY, lambda t, low: F.contains(t, F.lit("PRIVATE KEY-----"))),
    Rule("web_token", 1, r"\beyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++", lambda t, low: F.contains(t, F.lit("eyJ"))),
    Rule("host_token", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{16,}+|AIza[A-Za-z0-9_-]{35})", lambda t, low: F.contains(t, F.lit("gh")) | F.contains(t, F.lit("xox")) | F.contains(t, F.lit("AIza"))),
)
BASE = 3


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id, text, blob: each row with the address of its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def passing(found: Column, rule: Rule) -> Column:
    return F.filter(found, lambda x: rule.passes(x["m"]))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows of the ledger: blob, rules (name@version of those scanned now), found (rule, spans); also where nothing is found.

    ledger: earlier rows; pairs of a blob and a rule's version that it has aren't scanned, and blobs that it has for all
    rules have no row. One copy of each blob leaves a task, so many copies of a text are no hot key.
    """
    found = blobs(docs).groupBy("blob").agg(F.first("text").alias("text"))
    all_ = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        found = found.withColumn("rules", all_)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        found = found.join(seen, "blob", "left").withColumn("rules", F.array_except(all_, F.coalesce("seen", F.array().cast("array<string>"))))
        found = found.where(F.size("rules") > 0)
    low, text = F.lower("text"), F.col("text")
    rows = [
        F.when(F.array_contains("rules", r.key), F.struct(
            F.lit(r.key).alias("rule"),
            bare(F.when(r.guard(text, low), passing(matches(text, r.pattern, i), r)).otherwise(none())).alias("spans"),
        ))
        for i, r in enumerate(rules)
    ]
    return found.select("blob", "rules", F.filter(F.array_compact(F.array(*rows)), lambda x: F.size(x["spans"]) > 0).alias("found"))


SCANNED = "blob string, rules array<string>, found array<struct<rule:string,spans:array<struct<kind:int,s:int,e:int>>>>"


class Ledger:
    """All scans so far, a folder of tables: each pair of a blob and a rule's version is scanned once, in whatever version
    of the documents it appears first."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame | None:
        """What is kept; None before the first scan."""
        fs, top = file_system(self.spark, self.path)
        done = [x.getPath().toString() for x in fs.listStatus(top) if fs.exists(x.getPath().suffix("/_SUCCESS"))] if fs.exists(top) else []
        return self.spark.read.schema(SCANNED).parquet(*done) if done else None

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is unseen in docs and keeps it, findings and clean blobs alike; returns the new rows."""
        path = f"{self.path}/scan-{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            scan(docs, self.rows(), rules).write.parquet(path)
        return self.spark.read.schema(SCANNED).parquet(path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, found: spans of these rules' versions, of blobs that have any."""
        each = self.rows().where(F.size("found") > 0).select("blob", F.explode("found").alias("f")).where(F.col("f.rule").isin([r.key for r in rules]))
        return each.groupBy("blob").agg(F.flatten(F.collect_list("f.spans")).alias("found"))


def own_ledger(spark: SparkSession) -> Ledger:
    """An empty ledger for one use, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    fs, top = file_system(spark, path)
    fs.deleteOnExit(top)
    return Ledger(spark, path)


def secret_spans(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs.

    What the ledger lacks is scanned and kept in it; without one, all is. A null text is empty. Rows of one text, and
    repeated rows, get the findings of its blob, each row once. Overlaps of different rules all stay. An empty table
    gives no rows.
    """
    ledger = ledger or own_ledger(docs.sparkSession)
    ledger.update(docs, rules)
    rows = blobs(docs).select("doc_id", "blob").join(ledger.findings(rules), "blob", "left").select("doc_id", by_start(F.coalesce("found", bare(none()))).alias("found"))
    base = F.filter("found", lambda x: x["kind"] < BASE)
    names = [r.name for r in rules]
    return rows.select("doc_id", *[count(base, i).alias(f"n_{names[i]}") for i in range(BASE)], F.sha2(listed(base, names), 256).alias("base_sha256"), listed(F.col("found"), names).alias("spans"))


def redact(docs: DataFrame, ledger: Ledger | None = None, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every finding replaced by mark in text, and n_chars counted anew where there is one; other columns and rows stay.

    A null text stays null.
    """
    ledger = ledger or own_ledger(docs.sparkSession)
    ledger.update(docs, rules)
    blob, found, clean = fresh(docs.columns, "blob", "found", "clean")
    findings = ledger.findings(rules).select(F.col("blob").alias(blob), by_start(F.col("found")).alias(found))
    joined = docs.withColumn(blob, F.sha2("text", 256)).join(findings, blob, "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        """Overlapping findings share a mark."""
        apart = x["s"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    made = F.aggregate(found, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = joined.withColumn(clean, F.when(F.col(found).isNull(), F.col("text")).otherwise(made))

    def column(c: str) -> Column:
        if c == "text":
            return F.col(clean).alias(c)
        if c == "n_chars":
            return F.when(F.col(found).isNull(), F.col(c)).otherwise(F.length(clean)).cast(docs.schema[c].dataType).alias(c)
        return F.col(c)

    return out.select(*map(column, docs.columns))

"""Roll-ups of findings.  All are hash aggregations with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codesift.functions import text as tx
from codesift.operators.select import report_rank, severity_rank
from codesift.schemas import FINDINGS
from codesift.session import durable

# One address for all rows that stand for a package instead of a file.
DEPENDENCY_FILE = "DEPENDENCY"


def severity_counts(findings: DataFrame) -> DataFrame:
    s = F.coalesce("severity", F.lit("Medium"))
    return findings.agg(
        F.count_if(s == "Critical").alias("critical"),
        F.count_if(s == "High").alias("high"),
        F.count_if(s == "Medium").alias("medium"),
        F.count_if(s == "Low").alias("low"),
    )


def severity_sort(findings: DataFrame) -> DataFrame:
    """Findings in the order of a report.  They are written down first: the ends
    of the sorted ranges come from a pass of their own, which would find all of
    them once more."""
    return durable(findings).orderBy(report_rank(F.col("severity")), "file", "file_id", "line", "rule_id", "match_no")


# Findings of one place and kind are one.
PLACE = ["file_id", "file", "line", "type"]


def best_first() -> Column:
    """Order among the findings of a place: the smallest stands for all."""
    rest = [f.name for f in FINDINGS if f.name not in PLACE]
    return F.struct(
        (-severity_rank(F.col("severity"))).alias("_rank"), "phase", "rule_id", "match_no",
        *[c for c in rest if c not in ("phase", "rule_id", "match_no")])


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One row per (file, line, type) with the best severity.

    A minimum over a struct aggregates map-side, so a line with very many
    copies is reduced before the shuffle.
    """
    best = findings.groupBy(*PLACE).agg(F.min(best_first()).alias("b"), F.count("*").alias("n_merged"))
    return best.select(*[F.col(c) if c in PLACE else F.col(f"b.{c}") for c in FINDINGS.names], "n_merged")


def language_counts(findings: DataFrame) -> DataFrame:
    ext = tx.extension(F.col("file"))
    return (
        findings.where(F.col("file") != DEPENDENCY_FILE).select(ext.alias("ext")).where(F.col("ext") != "")
        .groupBy("ext").agg(F.count("*").alias("n"))
    )


def type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


def analysis_coverage(findings: DataFrame) -> DataFrame:
    """Files reached by each phase, and queries run."""
    return findings.groupBy("phase").agg(
        F.countDistinct("file_id").alias("files"), F.countDistinct("query_id").alias("queries"))


def scan_totals(files: DataFrame, findings: DataFrame, secrets: DataFrame) -> DataFrame:
    """Files, findings per level and secrets in one row, in one aggregation."""
    none = F.lit(None).cast("string")
    rows = (
        files.select(F.lit("file").alias("kind"), none.alias("severity"))
        .unionByName(findings.select(F.lit("finding").alias("kind"), "severity"))
        .unionByName(secrets.select(F.lit("secret").alias("kind"), none.alias("severity")))
    )
    k, s = F.col("kind"), F.col("severity")
    return rows.agg(
        F.count_if(k == "file").alias("total_files"),
        F.count_if(k == "finding").alias("total_findings"),
        F.count_if(k == "secret").alias("total_secrets"),
        F.count_if(s == "High").alias("high"),
        F.count_if(s == "Medium").alias("medium"),
        F.count_if(s == "Low").alias("low"),
    )


def vulnerable_vs_clean(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files with and without findings."""
    hit = findings.groupBy("file_id").agg(F.lit(True).alias("hit"))
    return files.select("file_id").join(hit, "file_id", "left").agg(
        F.count_if(F.col("hit")).alias("vulnerable"),
        F.count_if(F.col("hit").isNull()).alias("clean"))


def all_findings(*phases: DataFrame) -> DataFrame:
    out = phases[0]
    for df in phases[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out

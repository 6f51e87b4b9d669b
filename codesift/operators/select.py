"""Filters and projections over files and findings.  No step shuffles unless
it numbers rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from codesift.catalog.languages import EXCLUDED_DIRS, EXCLUDED_FILES, SEVERITY_RANKS, SUPPORTED_EXTENSIONS
from codesift.functions import text as tx
from codesift.operators.ordering import numbered
from codesift.session import durable


def _supported(extensions: list[str] | None) -> Column:
    path = F.col("path")
    known = [e.lower() for e in extensions] if extensions else list(SUPPORTED_EXTENSIONS)
    return ~tx.base_name(path).startswith(".") & tx.extension(path).isin(known)


def supported_files(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    return files.where(_supported(extensions))


def env_files(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Supported files and every ``.env`` file, for scans with secrets."""
    return files.where(_supported(extensions) | F.col("path").endswith(".env"))


def with_language(files: DataFrame) -> DataFrame:
    names = tx.text_map(SUPPORTED_EXTENSIONS)
    return files.withColumn("language", F.try_element_at(names, tx.extension(F.col("path"))))


def exclude_paths(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(~F.col("path").rlike(tx.java_regex(pattern)))


def _glob_regex(glob: str) -> str:
    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
    return f"^{body}$"


def exclude_dirs_files(
    files: DataFrame, dirs: list[str] = EXCLUDED_DIRS, globs: list[str] = EXCLUDED_FILES
) -> DataFrame:
    parts = F.split("path", "/", -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    keep = ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in dirs])) if dirs else F.lit(True)
    if globs:
        keep = keep & ~tx.base_name(F.col("path")).rlike("|".join(_glob_regex(g) for g in globs))
    return files.where(keep)


def severity_rank(severity: Column) -> Column:
    ranks = tx.text_map({k: str(v) for k, v in SEVERITY_RANKS.items()})
    return F.coalesce(F.try_element_at(ranks, severity).cast("int"), F.lit(0))


def severity_threshold(findings: DataFrame, level: str = "Low") -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) >= SEVERITY_RANKS[level])


def suppress_patterns(findings: DataFrame, patterns: list[str], column: str = "code") -> DataFrame:
    """Drop findings whose line matches one of the suppression regexes."""
    for p in patterns:
        findings = findings.where(~F.coalesce(F.col(column), F.lit("")).rlike(tx.java_regex(p)))
    return findings


def findings_filter(findings: DataFrame, search: str = "", severity: str = "all") -> DataFrame:
    row = F.lower(F.concat_ws(" ", "severity", "type", "file", F.col("line").cast("string"), "description"))
    keep = F.contains(row, F.lit(search.lower()))
    if severity != "all":
        keep = keep & (F.col("severity") == severity)
    return findings.where(keep)


def dependency_filter(findings: DataFrame, choice: str = "all") -> DataFrame:
    if choice == "all":
        return findings
    if choice == "dependency":
        return findings.where(F.col("phase") == "dependency")
    return findings.where(F.col("severity") == choice)


def report_rank(severity: Column) -> Column:
    """Order of the report: High, Medium, Low, then everything else."""
    return F.when(severity == "High", 0).when(severity == "Medium", 1).when(severity == "Low", 2).otherwise(3)


def short_path(path: Column) -> Column:
    """The last two parts of a path of more than two."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) > 2, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(path)


def short_text(text: Column, n: int = 50) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def findings_view(findings: DataFrame) -> DataFrame:
    """List view: number in report order, short names, short description."""
    order = [report_rank(F.col("severity")), F.col("file"), F.col("file_id"), F.col("line"),
             F.col("rule_id"), F.col("match_no")]
    # The order is sampled before it is sorted: the findings are written first.
    rows = numbered(durable(findings), order)
    return rows.select(
        "row_no", "severity", "type",
        tx.base_name(F.col("file")).alias("file_name"),
        F.when(F.col("file") == "DEPENDENCY", F.coalesce("dependency", F.lit("Unknown Package")))
        .otherwise(short_path(F.col("file"))).alias("short_path"),
        "line",
        short_text(F.col("description")).alias("description"),
    )

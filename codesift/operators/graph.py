"""Node and edge tables of files, findings and taint traces.

Ids are digests of stable keys, so no table has to be numbered by one task and
an id means the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codesift.catalog.structural import GRAPH_DANGEROUS_NAMES
from codesift.functions import text as tx
from codesift.operators.report import DEPENDENCY_FILE
from codesift.session import durable


def file_node_id(file: Column) -> Column:
    return F.concat(F.lit("file_"), F.md5(file.cast("binary")))


def finding_node_id() -> Column:
    key = F.concat_ws("|", "file", "phase", "rule_id", F.col("match_no").cast("string"), F.col("line").cast("string"))
    return F.concat(F.lit("vuln_"), F.md5(key.cast("binary")))


def _in_files(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("file") != DEPENDENCY_FILE)


def graph_nodes(findings: DataFrame) -> DataFrame:
    """One node per file with findings and one per finding.  The findings are
    read twice, so their columns are cut first."""
    rows = durable(_in_files(findings).select("file", "phase", "rule_id", "match_no", "line", "type", "severity"))
    none = F.lit(None).cast("string")
    file_nodes = rows.select("file").distinct().select(
        file_node_id(F.col("file")).alias("id"), tx.base_name(F.col("file")).alias("label"),
        F.lit("file").alias("type"), F.col("file").alias("path"), none.alias("severity"))
    return file_nodes.unionByName(rows.select(
        finding_node_id().alias("id"), F.coalesce("type", F.lit("Unknown")).alias("label"),
        F.lit("vulnerability").alias("type"), F.col("file").alias("path"),
        F.coalesce("severity", F.lit("Medium")).alias("severity")))


def graph_edges(findings: DataFrame) -> DataFrame:
    """``contains`` edges; both ends are derived from the finding itself."""
    return _in_files(findings).select(
        file_node_id(F.col("file")).alias("source"), finding_node_id().alias("target"),
        F.lit("contains").alias("type"))


def function_name(code: Column) -> Column:
    """Name of the function a snippet defines, or what it calls instead."""
    def first(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(code, pattern, group), F.lit(""))

    # Definition forms and fallback labels.
    name = F.coalesce(
        first(r"def\s+([a-zA-Z0-9_]+)\s*\(", 1),
        first(r"function\s+([a-zA-Z0-9_]+)\s*\(", 1),
        first(r"(const|let|var)\s+([a-zA-Z0-9_]+)\s*=\s*\(", 2),
    )
    call = F.lit("CodeSnippet")
    for n in reversed(GRAPH_DANGEROUS_NAMES):
        call = F.when(F.contains(code, F.lit(n)), F.lit(f"[Dangerous Call: {n}]")).otherwise(call)
    return F.coalesce(name, call)

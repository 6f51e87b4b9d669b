"""Shared row shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FILES = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("text", T.StringType()),
])

# One shape for the findings of every phase.  (file_id, rule_id, match_no)
# identifies a finding inside its phase.
FINDINGS = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("phase", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("match_no", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("mitigation", T.StringType()),
    T.StructField("dependency", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("advisory_id", T.StringType()),
    T.StructField("query_id", T.StringType()),
])


def as_findings(rows: DataFrame, phase: str, **columns: Column) -> DataFrame:
    """Project ``rows`` to the finding shape; absent columns become null."""
    columns["phase"] = F.lit(phase)
    out = []
    for f in FINDINGS:
        value = columns.get(f.name)
        if value is None:
            value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*out)

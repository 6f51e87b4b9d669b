"""The operators on a stream of new files.

Matching, secrets and scores hold no state, so a stream of files needs no
watermark: each micro-batch is scanned like a table and appended.

Merging the findings of a place and counting severities do hold state: one row
per key and window of the time a finding was made.  A watermark ends it; what is
late by no more than the delay is merged as if it had come in time.  Every
micro-batch writes the keys it changed to a folder of its own, replaced when the
batch is run again, and ``latest`` reads the newest row of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codesift.operators import report, score, search
from codesift.schemas import FILES, FINDINGS

# Findings are merged within a window; a batch may be late by the delay.
WINDOW = "1 day"
DELAY = "7 days"


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """Parquet tables in the shape of ``files`` that arrive in a folder."""
    return spark.readStream.schema(FILES).parquet(path)


def stream_findings(files: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return score.score_findings(search.pattern_findings(files, groups)).drop("increasing", "decreasing")


def write_stream(findings: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet by severity; replays after a failure are not doubled."""
    return (
        findings.writeStream.format("parquet").partitionBy("severity")
        .option("checkpointLocation", checkpoint).option("path", out)
        .trigger(availableNow=True).outputMode("append").start())


def merged_stream(findings: DataFrame, time: str = "found_at", window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """``report.dedup_findings`` kept up to date, per window of ``time``."""
    rows = findings.withWatermark(time, delay)
    best = rows.groupBy(F.window(time, window).alias("w"), *report.PLACE).agg(F.min(report.best_first()).alias("b"), F.count("*").alias("n_merged"))
    return best.select(
        F.col("w.start").alias("since"), *[F.col(c) if c in report.PLACE else F.col(f"b.{c}") for c in FINDINGS.names], "n_merged")


def counted_stream(findings: DataFrame, time: str = "found_at", window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """``report.severity_counts`` kept up to date, per window of ``time``."""
    s = F.coalesce("severity", F.lit("Medium"))
    levels = ["Critical", "High", "Medium", "Low"]
    rows = findings.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"))
    return rows.agg(*[F.count_if(s == x).alias(x.lower()) for x in levels]).select(F.col("w.start").alias("since"), *[x.lower() for x in levels])


def write_updates(state: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the keys each micro-batch changed; a batch that is run again after
    a failure replaces what it wrote."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        state.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("update").start())


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest row of each key that ``write_updates`` wrote."""
    rows = spark.read.parquet(out)
    rest = F.struct(*[c for c in rows.columns if c not in keys and c != "batch"])
    newest = rows.groupBy(*keys).agg(F.max_by(rest, "batch").alias("r"))
    return newest.select(*keys, "r.*")

"""Result sinks."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codesift.schemas import FINDINGS


def write_findings_json(findings: DataFrame, path: str, mode: str = "error", fmt: str = "json") -> None:
    """Findings by severity folder; every task writes its own files."""
    findings.withColumn("scanned_at", F.current_timestamp()).write.mode(mode).partitionBy("severity").format(fmt).save(path)


def write_report(path: str, findings: DataFrame, secrets: DataFrame, stats: DataFrame, mode: str = "error") -> None:
    """The whole report: findings, secrets and statistics side by side."""
    write_findings_json(findings, f"{path}/findings", mode)
    secrets.write.mode(mode).json(f"{path}/secrets")
    stats.write.mode(mode).json(f"{path}/stats")


# --- runs that may be tried again -----------------------------------------------
#
# Every attempt of a run writes a folder of its own below ``data``.  It counts
# once the run's manifest, a file that names the folder, is there.  Creating that
# file fails where it exists, on any file system, so one attempt of a run wins:
# a driver that dies before leaves data nobody reads, one that dies after has
# nothing left to do.


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _stage(findings: DataFrame, path: str, run: str) -> str:
    """Write an attempt; its folder below ``path``."""
    folder = f"data/run={run}/attempt={uuid.uuid4().hex}"
    findings.withColumn("scanned_at", F.current_timestamp()).write.partitionBy("severity").parquet(f"{path}/{folder}")
    return folder


def _commit(spark: SparkSession, path: str, run: str, folder: str) -> bool:
    """Whether this attempt is the run's; if not, its data goes."""
    fs, manifest = _hadoop(spark, f"{path}/commits/{run}")
    try:
        out = fs.create(manifest, False)
    except Py4JJavaError:
        if not fs.exists(manifest):
            raise
        fs.delete(_hadoop(spark, f"{path}/{folder}")[1], True)
        return False
    try:
        out.write(bytearray(folder.encode()))
    finally:
        out.close()
    return True


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of each finished run; a manifest cut off while it was written
    (its folder has no such data) is no manifest."""
    fs, commits = _hadoop(spark, f"{path}/commits")
    if not fs.exists(commits):
        return {}
    out = {}
    for status in fs.listStatus(commits):
        p = status.getPath()
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(p)))
        folder = reader.readLine() or ""
        reader.close()
        if folder.startswith("data/run=") and fs.exists(_hadoop(spark, f"{path}/{folder}/_SUCCESS")[1]):
            out[p.getName()] = folder
        elif p.getName() not in out:
            # The driver died inside the write: the run is open again.
            fs.delete(p, False)
    return out


def write_findings_once(findings: DataFrame, path: str, run: str) -> bool:
    """The findings of a named run, by severity; False where the run was there
    before.  May be tried again after any failure, with each finding once."""
    spark = findings.sparkSession
    if run in committed(spark, path):
        return False
    return _commit(spark, path, run, _stage(findings, path, run))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of all finished runs, with ``run`` and ``scanned_at``."""
    folders = committed(spark, path)
    schema = T.StructType([*FINDINGS, T.StructField("scanned_at", T.TimestampType()), T.StructField("run", T.StringType())])
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{path}/data").schema(schema).parquet(*[f"{path}/{f}" for f in sorted(folders.values())])
    return rows.select(schema.names)


def drop_leftovers(spark: SparkSession, path: str) -> int:
    """Delete attempts that lost or died; only while no run is being written."""
    kept = {f"{path}/{f}".rsplit("/", 2)[-1] for f in committed(spark, path).values()}
    fs, data = _hadoop(spark, f"{path}/data")
    gone = 0
    for run in fs.listStatus(data) if fs.exists(data) else []:
        for attempt in fs.listStatus(run.getPath()):
            if attempt.getPath().getName() not in kept:
                gone += bool(fs.delete(attempt.getPath(), True))
    return gone

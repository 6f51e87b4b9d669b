"""Checks of what is kept between runs: stored facts, committed findings and the
state of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.operators import report
from codesift.operators.fact_store import FactStore
from codesift.plans.checks import code as cc
from codesift.plans.checks.common import CODE, CODE_LINE, DOCS, FLOW, Check, pattern_found
from codesift.plans.checks.sources import doc_findings
from codesift.session import durable, scratch_folder
from codesift.sources import sinks, tables
from codesift.streaming import incremental


def _corpus(s, d):
    """Both code corpora; ids do not meet."""
    flow = tables.flow_files(s, d).withColumn("file_id", -1 - F.col("file_id"))
    return tables.code_files(s, d).unionByName(flow)


_CORPUS = f"SELECT file_id, path, text FROM ({CODE}) UNION ALL SELECT -1 - file_id, path, text FROM ({FLOW})"


def _even(files):
    return files.where(F.col("file_id") % 2 == 0)


def _stored(s, d):
    """Facts of the code files, half of them stored by a run before."""
    files, store = tables.code_files(s, d), FactStore(s, scratch_folder(s, "facts"))
    store.add(_even(files))
    return store.facts_of(store.add(files)).select("file_id", "path", *cc._FACT_COLUMNS)


def _parsed(s, d):
    """Texts parsed by a first run over half of the files, one over all, and a
    third that finds nothing new."""
    files, store = _corpus(s, d), FactStore(s, scratch_folder(s, "facts"))
    out = None
    for step, some in enumerate((_even(files), files, files)):
        store.add(some)
        row = durable(store.parsed().agg(F.count("*").alias("texts"))).select(F.lit(step).alias("step"), "texts")
        out = row if out is None else out.unionByName(row)
    return out


def _committed(s, d):
    """A run whose driver dies between write and commit, tried twice again, and
    a second run."""
    findings, path = durable(doc_findings(s, d)), scratch_folder(s, "findings")
    first, rest = findings.where("file_id % 2 = 0"), findings.where("file_id % 2 <> 0")
    sinks._stage(first, path, "r1")
    sinks.write_findings_once(first, path, "r1")
    sinks.write_findings_once(first, path, "r1")
    sinks.write_findings_once(rest, path, "r2")
    return sinks.read_findings(s, path).select("run", "file_id", "file", "line", "rule_id", "match_no", "severity", "code")


# Times of findings: within three days, in the order of the files.
_START = "2024-03-01 00:00:00"


def _arriving(s, d, state, keys):
    """Findings that come in three batches, the last one of earlier times, with
    a restart before each; then the newest row of every key."""
    time = F.timestamp_seconds(F.unix_timestamp(F.lit(_START)) + F.pmod("file_id", F.lit(4000)) * 60)
    findings = durable(doc_findings(s, d).withColumn("found_at", time))
    source, out, checkpoint = (scratch_folder(s, n) for n in ("arriving", "updates", "progress"))
    last = F.pmod("file_id", F.lit(3)) == 2
    for part in (~last & (F.pmod("file_id", F.lit(4000)) >= 400), ~last & (F.pmod("file_id", F.lit(4000)) < 400), last):
        findings.where(part).write.mode("append").parquet(source)
        stream = s.readStream.schema(findings.schema).parquet(source)
        incremental.write_updates(state(stream), out, checkpoint).awaitTermination()
    return incremental.latest(s, out, keys)


_FOUND = pattern_found(DOCS)
_TIMED = f"""WITH {_FOUND}, timed AS (SELECT file_id, path AS file, line, type, severity,
  date_trunc('day', TIMESTAMP '{_START}' + to_minutes(file_id % 4000)) AS since FROM found)"""
_RANK = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"


def _day():
    return F.date_format("since", "yyyy-MM-dd").alias("since")



CHECKS = {
    "fact_store": Check(_stored, cc._expect(cc._FACT_COLUMNS, cc._CODE_FACTS)),
    "fact_store_parsed": Check(
        _parsed,
        f"""WITH f AS ({_CORPUS}) SELECT step::INTEGER AS step, (SELECT count(DISTINCT text) FROM f WHERE step > 0 OR file_id % 2 = 0) AS texts
        FROM range(3) AS t(step)"""),
    "committed_findings": Check(
        _committed,
        f"""WITH {_FOUND} SELECT CASE WHEN file_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS run, file_id, path AS file, line, rule_id, match_no, severity,
        {CODE_LINE} AS code FROM found"""),
    "stream_merged_findings": Check(
        lambda s, d: _arriving(s, d, incremental.merged_stream, ["since", *report.PLACE]).select(
            _day(), "file_id", "file", "line", "type", "severity", "n_merged"),
        f"""{_TIMED} SELECT strftime(since, '%Y-%m-%d') AS since, file_id, file, line, type, arg_min(severity, {_RANK}) AS severity, count(*) AS n_merged
        FROM timed GROUP BY since, file_id, file, line, type"""),
    "stream_severity_counts": Check(
        lambda s, d: _arriving(s, d, incremental.counted_stream, ["since"]).select(_day(), "critical", "high", "medium", "low"),
        f"""{_TIMED} SELECT strftime(since, '%Y-%m-%d') AS since, {", ".join(f"count(*) FILTER (severity = '{x}') AS {x.lower()}" for x in ("Critical", "High", "Medium", "Low"))}
        FROM timed GROUP BY since"""),
}

"""Checks of whole scans: every phase over corpora of code and manifests."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codesift.operators import account, facts as fx, report
from codesift.plans import scan
from codesift.plans.checks import code as cc
from codesift.plans.checks.common import CODE, DOCS, FLOW, POLYGLOT, Check, _case, query_found
from codesift.plans.checks.dependencies import _FIRST, _HITS
from codesift.plans.checks.matching import _BOTH, _by_extension_sql
from codesift.session import ensure_checkpoint_dir
from codesift.sources import corpus, tables


def _corpora(*parts: DataFrame) -> DataFrame:
    """Corpora in one; each keeps its own file ids."""
    n = len(parts)
    return reduce(DataFrame.unionByName, [p.withColumn("file_id", F.col("file_id") * n + i) for i, p in enumerate(parts)])


def _code_files(s, d):
    return _corpora(tables.code_files(s, d), tables.flow_files(s, d), tables.polyglot_files(s, d))


def _project_files(s, d):
    return _corpora(tables.code_files(s, d), tables.flow_files(s, d), tables.manifest_files(s, d))


def _rows(findings: DataFrame) -> DataFrame:
    return findings.select("file", "phase", "rule_id", "line")


_SELECT = "path AS file, '{}' AS phase, rule_id, line"


def _of(phase: str, code: list[tuple], flow: list[tuple]) -> str:
    """Expected (kind, rule_id, line) rows of a phase."""
    return f"SELECT {_SELECT.format(phase)} FROM ({cc._expect(['rule_id', 'line'], code, flow)})"


# Calls in the snippets of other languages that are Python: (kind, line).
_SNIPPET_CALLS = [(0, 2), (0, 3), (2, 1)]
_SNIPPETS = " UNION ALL ".join(
    f"SELECT path AS file, 'call' AS phase, 'dangerous-call' AS rule_id, {line}::INTEGER AS line FROM ({POLYGLOT}) WHERE file_id % {len(tables.SNIPPETS)} = {kind}"
    for kind, line in _SNIPPET_CALLS)
_PATTERNS = _by_extension_sql().replace(_BOTH, " UNION ALL ".join(
    f"SELECT file_id * 3 + {i} AS file_id, path, text FROM ({c})" for i, c in enumerate((CODE, FLOW, POLYGLOT))))
_CALLS = _of("call", [(5, "syntax-error", 0)], [
    (0, "dangerous-call", 6), (3, "dangerous-call", 6), (4, "dangerous-call", 5), (4, "user-input", 4), (5, "dangerous-call", 5)])
_PATTERN_SCAN = f"SELECT file, 'pattern' AS phase, rule_id, line FROM ({_PATTERNS}) UNION ALL {_CALLS} UNION ALL {_SNIPPETS}"

_RULES = _of(
    "rule",
    [(k, r, line) for k, r, _s, line in cc._RULE_CALLS["code"]] + [(4, "PY-HARDCODED-SECRET-001", 1), (7, "PY-BARE-EXCEPT-001", 4)],
    [(k, r, line) for k, r, _s, line in cc._RULE_CALLS["flow"]]
    + [(2, "PY-INSECURE-RANDOM-001", 1), (5, "PY-WEAK-CRYPTO-001", 1), (3, "PY-HARDCODED-SECRET-001", 7)])


def _taint_rows(sinks):
    return [(k, f"taint:{sink}:{var}", line) for k, line, sink, _w, _s, var, _o in sinks]


_TAINT = _of("taint", _taint_rows(cc._CODE_SINKS), _taint_rows(cc._FLOW_SINKS))
_FLOW_PHASE = _of("flow", [(7, "bare-except", 1), (3, "unmanaged-open", 1)], [(1, "unmanaged-open", 5)])
_N = len(tables.MANIFESTS)
_MANIFESTS = f"""SELECT p_partkey AS file_id, 'proj' || p_partkey::VARCHAR || '/' || {_case('p_partkey', [n for n, _ in tables.MANIFESTS])} AS path,
  replace(replace({_case('p_partkey', [t for _, t in tables.MANIFESTS])}, '{{name}}', replace(p_name, ' ', '-')),
    '{{version}}', (p_partkey % 7)::VARCHAR || '.' || (p_partkey % 25)::VARCHAR || '.' || (p_partkey % 30)::VARCHAR) AS text FROM part"""
_PROJECTS = " UNION ALL ".join(f"SELECT file_id * 3 + {i} AS file_id, path, text FROM ({c})" for i, c in enumerate((CODE, FLOW, _MANIFESTS)))
_QUERIES = f"WITH {query_found(_PROJECTS)} SELECT path AS file, 'query' AS phase, query_id AS rule_id, line FROM found"
_DEPENDENCIES = f"WITH {_HITS}, {_FIRST} SELECT 'DEPENDENCY' AS file, 'dependency' AS phase, advisory_id AS rule_id, 0::INTEGER AS line FROM firsts"
_ADVANCED_SCAN = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (_RULES, _TAINT, _FLOW_PHASE, _QUERIES, _DEPENDENCIES))


def _coverage(s, d):
    """Findings per phase of both scans over their corpora."""
    found = report.all_findings(
        scan.pattern_scan(_code_files(s, d)).findings.drop("increasing", "decreasing"), scan.advanced_scan(_project_files(s, d)).findings)
    return found.groupBy("phase").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


# A manifest that does not parse, and a source too deep to parse.
_BROKEN = "{ not a manifest"
_DEEP = "x = " + "-" * 100_000 + "1"
_CAP = 5000


def _broken_files(s, d):
    """The manifests, with every eleventh of the JSON and TOML ones cut, one
    kind of code file too deep for the parser, and the documents."""
    k = F.col("file_id")
    manifests = tables.manifest_files(s, d).withColumn("text", F.when(k % 11 == 0, _BROKEN).otherwise(F.col("text")))
    code = tables.code_files(s, d).withColumn("text", F.when(k % 8 == 0, _DEEP).otherwise(F.col("text")))
    return _corpora(manifests, code, tables.document_files(s, d)).withColumn(
        "size", F.when(F.col("path").endswith(".py"), F.lit(0)).otherwise(F.length("text")).cast("long"))


def _skipped(s, d):
    files = _broken_files(s, d)
    return account.skipped_files(files, fx.fact_table(files.where(F.col("path").endswith(".py"))), _CAP).select("path", "reason")


_PARSED_NAMES = ", ".join(f"'{n}'" for n in account.PARSED_MANIFESTS)
_SKIPPED = f"""SELECT path, 'manifest does not parse' AS reason FROM ({_MANIFESTS}) WHERE file_id % 11 = 0 AND string_split(path, '/')[-1] IN ({_PARSED_NAMES})
UNION ALL SELECT path, 'source does not parse' FROM ({CODE}) WHERE file_id % 8 = 0
UNION ALL SELECT path, 'too large' FROM ({DOCS}) WHERE length(text) > {_CAP}"""


def _write_folders(docs, folder: str, file_bytes: int = 16 << 20, file_rows: int = 10_000) -> None:
    """``docs(folder, doc_id, value)`` as text files of bounded size, a folder per source."""
    size = docs.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    ways = size // file_bytes + 1
    salt = F.pmod(F.xxhash64("doc_id", "value"), F.lit(ways))
    docs.repartition("folder", salt).drop("doc_id").write.option("maxRecordsPerFile", file_rows).partitionBy("folder").text(folder)


def _round_trip(s, d):
    """Documents written as text files, one folder per source, and read back
    as a corpus: bytes and lines per folder."""
    ensure_checkpoint_dir(s)
    folder = f"{s.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    line = F.regexp_replace("text", r"[\n\r]", " ")
    docs = tables.table(s, d, "documents").select(F.concat("source", F.lit("")).alias("folder"), "doc_id", line.alias("value"))
    _write_folders(docs, folder)
    files = corpus.read_corpus(s, folder, max_bytes=None, glob="*.txt", hidden=False)
    name = F.regexp_extract("path", "folder=([^/]*)/", 1)
    return files.groupBy(name.alias("source")).agg(
        F.sum("size").alias("bytes"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"))


CHECKS = {
    "pattern_scan": Check(lambda s, d: _rows(scan.pattern_scan(_code_files(s, d)).findings), _PATTERN_SCAN),
    "advanced_scan": Check(lambda s, d: _rows(scan.advanced_scan(_project_files(s, d)).findings), _ADVANCED_SCAN),
    "scan_coverage": Check(
        _coverage,
        f"""SELECT phase, count(*) AS findings, count(DISTINCT file) AS files FROM (SELECT * FROM ({_PATTERN_SCAN})
        UNION ALL SELECT * FROM ({_ADVANCED_SCAN})) GROUP BY 1"""),
    "skipped_files": Check(_skipped, _SKIPPED),
    "corpus_round_trip": Check(
        _round_trip,
        "SELECT source, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, count(*) AS lines FROM documents GROUP BY 1"),
}

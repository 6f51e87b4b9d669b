"""Checks of scores, roll-ups and graph tables (R and N keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.catalog import scoring as cat
from codesift.catalog.structural import GRAPH_DANGEROUS_NAMES
from codesift.operators import graph, report, score, search, secrets as sec
from codesift.plans.checks.common import (
    CODE, CODE_LINE, DOCS, FLOW, PAGES, POLYGLOT, Check, any_of, base_name, ext, lit, pattern_found, pattern_rows,
    secret_found, values)
from codesift.plans.checks.matching import _BOTH, _GROUP, BY_EXTENSION, _FP, _both, _by_extension_sql
from codesift.sources import tables

# Findings of two sorts of text: prose (generic and sensitive groups) and code
# of many languages (rules by extension).


def _findings(s, d):
    docs = search.pattern_findings(tables.document_files(s, d), ["generic", "sensitive_data"])
    code = search.pattern_findings(tables.polyglot_files(s, d).withColumn("file_id", -1 - F.col("file_id")))
    return report.all_findings(docs, code)


def _scored(s, d):
    return score.score_findings(_findings(s, d))


_CODE_FOUND = _by_extension_sql().removeprefix("WITH ")
_TYPES = {r[0]: r[2] for r in pattern_rows(BY_EXTENSION)}
_ALL_ROWS = pattern_rows(BY_EXTENSION + ["sensitive_data"])
# One relation ``f``: findings of the documents, then of the code corpus.
_BASE = f"""{pattern_found(DOCS)},
code_found AS (WITH {_CODE_FOUND.replace(_BOTH, f"SELECT -1 - file_id AS file_id, path, text FROM ({POLYGLOT})")}),
{values('labels', ['rule_id', 'type', 'severity', 'confidence', 'description'], [(r[0], r[2], r[4], r[5], r[6]) for r in _ALL_ROWS])},
f AS (SELECT file_id, path AS file, rule_id, match_no, line, {CODE_LINE} AS code, severity, type, description FROM found
  UNION ALL SELECT c.file_id, c.file, c.rule_id, c.match_no, c.line, c.code, l.severity, l.type, l.description
  FROM code_found c JOIN labels l USING (rule_id))"""


def _factors(words: list[str], sentence: str) -> str:
    return "list_filter([" + ", ".join(
        f"CASE WHEN contains(lc, {lit(w)}) THEN {lit(sentence.format(w))} END" for w in words) + "], lambda x: x IS NOT NULL)"


def _when(kind: str, test: str, sentence: str) -> str:
    return f"CASE WHEN type = {lit(kind)} AND {test} THEN {lit(sentence)} END"


_UP = "list_filter([" + ", ".join(
    [_when("Command Execution", any_of("lc", ["+", 'f"', "${", "%s"]), cat.DYNAMIC_COMMAND_TEXT),
     _when("SQL Injection", any_of("lc", ["+", "concat"]), cat.CONCATENATED_SQL_TEXT)]
    + [_when("Hard-coded Credentials", f"contains(lc, {lit(w)})", cat.HARD_CODED_TEXT.format(w)) for w in cat.HARD_CODED_WORDS]
) + "], lambda x: x IS NOT NULL)"
_DOWN = "list_filter([" + ", ".join([
    _when("Command Execution", any_of("lc", ["validate", "sanitize", "escape"]), cat.VALIDATED_COMMAND_TEXT),
    _when("SQL Injection", "((contains(lc, '?') AND contains(lc, 'execute')) OR contains(lc, '%s')) AND NOT contains(lc, 'concatenat') AND NOT contains(lc, '+')", cat.PARAMETERIZED_SQL_TEXT),
    _when("XSS", any_of("lc", ["escape", "sanitize", "htmlspecialchars"]), cat.ENCODED_OUTPUT_TEXT)]) + "], lambda x: x IS NOT NULL)"
_LEVELS = values("levels", ["type", "base"], list(cat.BASE_SEVERITY.items()))
_SCORED = f"""{_BASE}, {_LEVELS},
factors AS (SELECT f.*, lower(code) AS lc, coalesce(base, 'Medium') AS base_severity FROM f LEFT JOIN levels USING (type)),
parts AS (SELECT *, {_factors(cat.HIGH_RISK_WORDS, cat.HIGH_RISK_TEXT)} AS kw_up, {_factors(cat.LOW_RISK_WORDS, cat.LOW_RISK_TEXT)} AS kw_down,
  {_UP} AS ty_up, {_DOWN} AS ty_down FROM factors),
sums AS (SELECT *, list_concat(kw_up, ty_up) AS up, list_concat(kw_down, ty_down) AS down FROM parts),
scored AS (SELECT * REPLACE (['Low', 'Medium', 'High'][greatest(1, least(3,
    CASE base_severity WHEN 'High' THEN 3 WHEN 'Low' THEN 1 ELSE 2 END + least(len(up), 2) - least(len(down), 2)))] AS severity),
  CASE WHEN len(up) > 2 OR len(down) > 2 THEN 'High' ELSE 'Medium' END AS confidence FROM sums)"""
_RANK = "CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END"
_KEY = ["file_id", "rule_id", "match_no"]


def _factor_rows(s, d):
    from codesift.functions import text as tx  # noqa: F401

    code = F.lower("code")
    words, kinds = score.keyword_factors(code), score.type_factors(F.col("type"), code)
    rows = _findings(s, d)
    return rows.select(
        *_KEY, *[F.array_join(c, "; ").alias(n) for n, c in zip(
            ("kw_up", "kw_down", "ty_up", "ty_down"), (*words, *kinds))])


def _doc_secrets(s, d):
    return sec.drop_false_positives(sec.scan_sensitive(tables.document_files(s, d), context=False))


_SECRETS = f"""{secret_found(DOCS)}, secrets AS (SELECT * FROM found WHERE NOT regexp_matches(lines[line], {_FP}))"""
_FILE_ID = "'file_' || md5(file)"
_VULN_ID = "'vuln_' || md5(concat_ws('|', file, 'pattern', rule_id, match_no::VARCHAR, line::VARCHAR))"


def _phases(s, d):
    """Three phases over one corpus."""
    files = tables.polyglot_files(s, d)
    return report.all_findings(
        search.pattern_findings(files), search.run_all_queries(files),
        search.pattern_findings(tables.flow_files(s, d).withColumn("file_id", -1 - F.col("file_id"))))


def _query_sql(corpus: str) -> str:
    from codesift.plans.checks.common import query_found

    return query_found(corpus)


_POLY_BY_EXT = _by_extension_sql().replace(_BOTH, POLYGLOT)
_FLOW_BY_EXT = _by_extension_sql().replace(_BOTH, f"SELECT -1 - file_id AS file_id, path, text FROM ({FLOW})")
_PHASES = f"""pattern_rows AS (({_POLY_BY_EXT}) UNION ALL ({_FLOW_BY_EXT})),
query_rows AS (WITH {_query_sql(POLYGLOT)} SELECT * FROM found)"""


def _snippets(s, d):
    files = tables.flow_files(s, d).select("file_id", "path", "text").unionByName(
        tables.polyglot_files(s, d).select("file_id", "path", "text"))
    return files.select("file_id", "path", graph.function_name(F.col("text")).alias("name"))


def _call_name_sql() -> str:
    whens = " ".join(f"WHEN contains(text, {lit(n)}) THEN {lit(f'[Dangerous Call: {n}]')}" for n in GRAPH_DANGEROUS_NAMES)
    return rf"""coalesce(nullif(regexp_extract(text, 'def\s+([a-zA-Z0-9_]+)\s*\(', 1), ''),
      nullif(regexp_extract(text, 'function\s+([a-zA-Z0-9_]+)\s*\(', 1), ''),
      nullif(regexp_extract(text, '(const|let|var)\s+([a-zA-Z0-9_]+)\s*=\s*\(', 2), ''),
      CASE {whens} ELSE 'CodeSnippet' END)"""


CHECKS = {
    "base_severity": Check(
        lambda s, d: _findings(s, d).select(*_KEY, "type", score.base_severity(F.col("type")).alias("base_severity")),
        f"WITH {_SCORED} SELECT file_id, rule_id, match_no, type, base_severity FROM scored"),
    "keyword_factors": Check(
        lambda s, d: _factor_rows(s, d).select(*_KEY, "kw_up", "kw_down"),
        f"WITH {_SCORED} SELECT file_id, rule_id, match_no, array_to_string(kw_up, '; ') AS kw_up, array_to_string(kw_down, '; ') AS kw_down FROM scored"),
    "type_factors": Check(
        lambda s, d: _factor_rows(s, d).select(*_KEY, "ty_up", "ty_down"),
        f"WITH {_SCORED} SELECT file_id, rule_id, match_no, array_to_string(ty_up, '; ') AS ty_up, array_to_string(ty_down, '; ') AS ty_down FROM scored"),
    "risk_score": Check(
        lambda s, d: _scored(s, d).select(*_KEY, "type", "base_severity", "rule_severity", "severity"),
        f"""WITH {_SCORED} SELECT s.file_id, s.rule_id, s.match_no, s.type, s.base_severity, f.severity AS rule_severity, s.severity
        FROM scored s JOIN f USING (file_id, rule_id, match_no)"""),
    "risk_confidence": Check(
        lambda s, d: _scored(s, d).select(*_KEY, "confidence"),
        f"WITH {_SCORED} SELECT file_id, rule_id, match_no, confidence FROM scored"),
    "risk_explanation": Check(
        lambda s, d: _scored(s, d).select(*_KEY, "explanation"),
        f"""WITH {_SCORED} SELECT file_id, rule_id, match_no, 'The ' || type || ' vulnerability is assessed as ' || severity || ' severity.'
        || CASE WHEN len(up) > 0 THEN ' Risk factors: ' || array_to_string(up[1:2], '; ') || '.' ELSE '' END
        || CASE WHEN len(down) > 0 THEN ' Mitigating factors: ' || array_to_string(down[1:2], '; ') || '.' ELSE '' END
        || ' (AI assessment)' AS explanation FROM scored"""),
    "severity_counts": Check(
        lambda s, d: report.severity_counts(_findings(s, d)),
        f"""WITH {_BASE} SELECT count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
        count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM f"""),
    "severity_sort": Check(
        lambda s, d: report.severity_sort(_scored(s, d)).select("severity", "file", "line", "type", "rule_id"),
        f"WITH {_SCORED} SELECT severity, file, line, type, rule_id FROM scored ORDER BY {_RANK}, file, file_id, line, rule_id, match_no"),
    "dedup_findings": Check(
        lambda s, d: report.dedup_findings(_scored(s, d)).select("file_id", "file", "line", "type", "severity", "n_merged"),
        f"""WITH {_SCORED} SELECT file_id, file, line, type, ['High', 'Medium', 'Low'][min({_RANK}) + 1] AS severity, count(*) AS n_merged
        FROM scored GROUP BY 1, 2, 3, 4"""),
    "language_counts": Check(
        lambda s, d: report.language_counts(
            report.all_findings(_findings(s, d), search.pattern_findings(tables.page_files(s, d)))),
        f"""WITH {_BASE}, paged AS (WITH {pattern_found(PAGES, ['generic'])} SELECT path AS file FROM found),
        e AS (SELECT {ext('file')} AS ext FROM (SELECT file FROM f UNION ALL SELECT file FROM paged))
        SELECT ext, count(*) AS n FROM e WHERE ext <> '' GROUP BY 1"""),
    "type_counts": Check(
        lambda s, d: report.type_counts(_findings(s, d)),
        f"WITH {_BASE} SELECT type, count(*) AS n FROM f GROUP BY 1"),
    "analysis_coverage": Check(
        lambda s, d: report.analysis_coverage(_phases(s, d)),
        f"""WITH {_PHASES} SELECT 'pattern' AS phase, count(DISTINCT file_id) AS files, 0::BIGINT AS queries FROM pattern_rows
        UNION ALL SELECT 'query', count(DISTINCT file_id), count(DISTINCT query_id) FROM query_rows"""),
    "scan_totals": Check(
        lambda s, d: report.scan_totals(tables.document_files(s, d), _scored(s, d), _doc_secrets(s, d)),
        f"""WITH {_SCORED}, sens AS (WITH {_SECRETS} SELECT count(*) AS n FROM secrets)
        SELECT (SELECT count(*) FROM documents) AS total_files, count(*) AS total_findings, (SELECT n FROM sens) AS total_secrets,
        count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM scored"""),
    "vulnerable_vs_clean": Check(
        lambda s, d: report.vulnerable_vs_clean(
            _both(s, d), _findings(s, d)),
        f"""WITH {_BASE}, ids AS (SELECT file_id FROM ({_BOTH})), seen AS (SELECT DISTINCT file_id FROM f)
        SELECT (SELECT count(*) FROM ids SEMI JOIN seen USING (file_id)) AS vulnerable, (SELECT count(*) FROM ids ANTI JOIN seen USING (file_id)) AS clean"""),
    "all_findings": Check(
        lambda s, d: _phases(s, d).select("file_id", "file", "phase", "rule_id", "match_no", "line", "code", "query_id"),
        f"""WITH {_PHASES} SELECT file_id, file, 'pattern' AS phase, rule_id, match_no, line, code, NULL AS query_id FROM pattern_rows
        UNION ALL SELECT file_id, path, 'query', query_id, match_no, line, match, query_id FROM query_rows"""),
    "graph_nodes": Check(
        lambda s, d: graph.graph_nodes(_findings(s, d)),
        f"""WITH {_BASE} SELECT DISTINCT {_FILE_ID} AS id, {base_name('file')} AS label, 'file' AS type, file AS path, NULL::VARCHAR AS severity FROM f
        UNION ALL SELECT {_VULN_ID}, type, 'vulnerability', file, severity FROM f"""),
    "graph_edges": Check(
        lambda s, d: graph.graph_edges(_findings(s, d)),
        f"WITH {_BASE} SELECT {_FILE_ID} AS source, {_VULN_ID} AS target, 'contains' AS type FROM f"),
    "function_name": Check(
        _snippets,
        f"""WITH s AS (SELECT file_id, path, text FROM ({FLOW}) UNION ALL SELECT file_id, path, text FROM ({POLYGLOT}))
        SELECT file_id, path, {_call_name_sql()} AS name FROM s"""),
}

"""Shared pieces of the check queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from codesift.catalog.patterns import PATTERN_ROWS
from codesift.catalog.queries import SAVED_QUERY_ROWS
from codesift.catalog.secrets import SECRET_ROWS
from codesift.sources import tables


class Check(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def lit(value) -> str:
    """A value as a SQL literal of the oracle's dialect."""
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ",\n".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


BLANKS = "".join(chr(c) for c in range(1, 0x3001) if chr(c).isspace())


def strip(expr: str) -> str:
    return f"trim({expr}, {lit(BLANKS)})"


def base_name(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def ext(path: str) -> str:
    return rf"lower(regexp_extract({base_name(path)}, '^\.*[^.].*(\.[^.]*)$', 1))"


DOCS = ("SELECT doc_id AS file_id, source || '/' || doc_id::VARCHAR || '.' || lang AS path, "
        "length(text)::BIGINT AS size, text FROM documents")
PAGES = "SELECT page_id AS file_id, regexp_replace(url, '[?#].*', '') AS path, length(html)::BIGINT AS size, html AS text FROM pages"
CONVERSATIONS = ("SELECT conv_id * 1048576 + turn AS file_id, 'conv/' || conv_id::VARCHAR || '/' || turn::VARCHAR || '.txt' AS path, "
                 "length(text)::BIGINT AS size, text FROM conversations")


def _case(key: str, texts: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {lit(t.replace('{{', '{').replace('}}', '}'))}" for i, t in enumerate(texts))
    return f"CASE {key} % {len(texts)} {whens} END"


def _part_corpus(name: str, ext_: str, texts: list[str]) -> str:
    return (f"SELECT p_partkey AS file_id, 'repo' || (p_partkey % 97)::VARCHAR || '/{name}' || p_partkey::VARCHAR || '.' || {ext_} AS path, "
            f"replace({_case('p_partkey', texts)}, '{{brand}}', p_brand) AS text FROM part")


CODE = _part_corpus("mod", "'py'", tables.CODE_KINDS)
FLOW = _part_corpus("app", "'py'", tables.FLOW_KINDS)
POLYGLOT = _part_corpus("src", _case("p_partkey", [e for e, _ in tables.SNIPPETS]), [t for _, t in tables.SNIPPETS])


def pattern_rows(groups: list[str]) -> list[tuple]:
    """(rule_id, grp, type, pattern, severity, confidence, description)"""
    seen, out = {}, []
    for g, kind, pattern, desc, sev, conf, _cwe, _hints in PATTERN_ROWS:
        seen[g] = seen.get(g, 0) + 1
        if g in groups:
            out.append((f"{g}-{seen[g]}", g, kind, pattern, sev, conf, desc))
    return out


PATTERN_COLUMNS = ["rule_id", "grp", "type", "pattern", "severity", "confidence", "description"]
GENERAL_GROUPS = ["generic", "sensitive_data"]


def found(files_sql: str, columns: list[str], rows: list[tuple], on: str = "TRUE", flags: str = "") -> str:
    """CTEs ``files``, ``rules``, ``hit`` and ``found``: every match with its
    line, computed from the pieces between the matches."""
    pattern = f"'{flags}' || r.pattern" if flags else "r.pattern"
    return f"""files AS ({files_sql}),
{values('rules', columns, rows)},
hit AS (SELECT f.file_id, f.path, f.text, r.*, regexp_extract_all(f.text, {pattern}) AS m,
    string_split_regex(f.text, {pattern}) AS g
  FROM files f JOIN rules r ON {on} WHERE regexp_matches(f.text, {pattern})),
placed AS (SELECT hit.*, (k - 1)::INTEGER AS match_no, m[k] AS match,
    array_to_string(g[1:k], '') || array_to_string(m[1:k-1], '') AS before
  FROM hit, unnest(range(1, len(m) + 1)) AS t(k)),
found AS (SELECT * EXCLUDE (before, m, g, text),
    (1 + length(before) - length(replace(before, chr(10), '')))::INTEGER AS line,
    string_split(text, chr(10)) AS lines FROM placed)"""


def pattern_found(files_sql: str, groups: list[str] = GENERAL_GROUPS) -> str:
    return found(files_sql, PATTERN_COLUMNS, pattern_rows(groups))


SECRET_COLUMNS = ["rule_id", "category", "pattern"]


def secret_found(files_sql: str) -> str:
    rows = [(f"secret-{i}", c, p) for i, (c, p, _h) in enumerate(SECRET_ROWS, 1)]
    return found(files_sql, SECRET_COLUMNS, rows)


QUERY_COLUMNS = ["query_id", "name", "severity", "pattern"]


def query_found(files_sql: str, query_id: str | None = None) -> str:
    rows = [(i, n, s, p) for i, n, _d, _l, _t, p, s, _g in SAVED_QUERY_ROWS if query_id in (None, i)]
    return found(files_sql, QUERY_COLUMNS, rows, f"{ext('f.path')} = '.py'", "(?m)")


CODE_LINE = strip("lines[line]")
CONTEXT = "array_to_string(lines[greatest(line - 2, 1):line + 2], chr(10))"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"

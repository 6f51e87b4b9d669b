"""Checks of the match and secret operators (M and P keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.catalog import secrets as cat
from codesift.catalog.queries import DANGEROUS_EVAL_PATTERN, SAVED_QUERY_ROWS
from codesift.functions import text as tx
from codesift.operators import secrets as sec
from codesift.operators import late, prefilter, search, trigrams
from codesift.operators.match import find_matches
from codesift.plans.checks.common import (
    CODE, CODE_LINE, CONTEXT, CONVERSATIONS, DOCS, FLOW, PAGES, POLYGLOT, SECRET_COLUMNS, Check, any_of, ext, found,
    lit, pattern_found, pattern_rows, query_found, secret_found, strip, values)
from codesift.session import scratch_folder
from codesift.sources import catalogues, tables

GENERAL = ["generic", "sensitive_data"]
BY_EXTENSION = search.EXTENSION_GROUPS + ["generic"]


def _docs(s, d):
    return tables.document_files(s, d)


def _general(s, d, **more):
    return find_matches(_docs(s, d), catalogues.pattern_rules(GENERAL), **more)


def _both(s, d):
    """Documents and code of many languages in one corpus."""
    code = tables.polyglot_files(s, d).withColumn("file_id", -1 - F.col("file_id"))
    return _docs(s, d).unionByName(code)


_BOTH = f"SELECT file_id, path, text FROM ({DOCS}) UNION ALL SELECT -1 - file_id, path, text FROM ({POLYGLOT})"
_GROUP = f"CASE WHEN substr({ext('f.path')}, 2) IN ({', '.join(lit(g) for g in search.EXTENSION_GROUPS)}) THEN substr({ext('f.path')}, 2) ELSE 'generic' END"


def _by_extension_sql() -> str:
    """The one pattern the oracle's engine cannot run, a look-ahead, is found
    by its plain part plus a condition on the rest of the line."""
    plain = [r for r in pattern_rows(BY_EXTENSION) if "(?!" not in r[3]]
    cols = ["rule_id", "grp", "type", "pattern", "severity", "confidence", "description"]
    return f"""WITH {found(_BOTH, cols, plain, f"r.grp = {_GROUP}")}
        SELECT file_id, path AS file, rule_id, match_no, line, match, {CODE_LINE} AS code, severity FROM found
        UNION ALL
        SELECT file_id, path, 'c-4', (row_number() OVER (PARTITION BY file_id ORDER BY i) - 1)::INTEGER, i::INTEGER,
          regexp_extract(l, 'malloc\\s*\\([^)]+\\)'), {strip('l')}, 'Medium'
        FROM (SELECT file_id, path, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
          FROM ({_BOTH}) AS f WHERE {ext('path')} = '.c')
        WHERE regexp_matches(l, 'malloc\\s*\\([^)]+\\)') AND NOT regexp_matches(l, 'malloc\\s*\\([^)]+\\).*free')"""


def _match_rules(s, d):
    rows = search.match_rules(_both(s, d))
    return rows.select("file_id", F.col("path").alias("file"), "rule_id", "match_no", "line", "match", "code", "severity")


def _match_rules_in_one_pass(s, d):
    files = _both(s, d)
    rows = prefilter.find_many(files, catalogues.pattern_rules(BY_EXTENSION), search.rule_group(F.col("path")))
    return rows.select("file_id", F.col("path").alias("file"), "rule_id", "match_no", "line", "match", "code", "severity")


def _lines_once(s, d):
    """Matches of the general rules and their lines, put together again."""
    found = late.find_matches_late(_docs(s, d), catalogues.pattern_rules(GENERAL))
    return late.with_lines_of(found.matches, found.lines).select("file_id", "rule_id", "match_no", "line", "match", "code", "context")


def _function_rows(names: list[str]) -> list[tuple]:
    return [(n, i, p) for n in names for i, p in enumerate(search.function_patterns(n))]


def _new_queries(s, d):
    return tables.table(s, d, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.lit("x").alias("pattern"),
        F.lit("python").alias("language"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("description"))


def _taken(s, d):
    """Ids in use: the built-in queries, and names of large parts."""
    library = catalogues.query_table(s).select("id")
    dashed = F.replace("p_name", F.lit(" "), F.lit("-"))
    used = tables.table(s, d, "part").where(F.col("p_size") == 50).select(
        F.when(F.col("p_partkey") % 2 == 0, dashed).otherwise(F.concat(dashed, F.lit("-2"))).alias("id")).distinct()
    return library.unionByName(used)


def _secrets(s, d):
    return sec.scan_sensitive(_docs(s, d))


_FP = lit("|".join(f"(?:{p})" for p in cat.FALSE_POSITIVE_PATTERNS))
_SENSITIVE = lit("(?i)" + "|".join(f"(?:{p})" for p in cat.SENSITIVE_FILE_PATTERNS))
_CATEGORY_SEVERITY = ("CASE WHEN category IN ('certificates', 'api_key', 'credentials', 'aws') THEN 'High' "
                      "WHEN category IN ('pii', 'oauth', 'database', 'jwt') THEN 'Medium' "
                      f"WHEN regexp_matches(path, {_SENSITIVE}) THEN 'High' ELSE 'Low' END")
_SECRETS = f"""{secret_found(DOCS)},
secrets AS (SELECT file_id, path AS file, rule_id, category, match_no, line, match, {CONTEXT} AS context,
  regexp_matches(lines[line], {_FP}) AS probable_false_positive, regexp_matches(path, {_SENSITIVE}) AS is_sensitive_file,
  {_CATEGORY_SEVERITY} AS severity FROM found)"""

_ENV_KEY = lit("(?i)" + "|".join(cat.ENV_KEY_PATTERNS))


def _env_sql() -> str:
    """Expected rows straight from the customer columns, without any text."""
    def mask(v: str) -> str:
        return f"CASE WHEN length({v}) <= 4 THEN repeat('*', length({v})) ELSE left({v}, 2) || repeat('*', length({v}) - 4) || right({v}, 2) END"

    rows = [
        (3, "DB_PASSWORD", "c_name", "High"),
        (4, "api_key", "'k=' || printf('%.2f', c_acctbal)", "High"),
        (5, "AUTH_URL", "'http://h/' || c_custkey::VARCHAR", "Medium"),
        (6, "PIN_HASH", "c_custkey::VARCHAR", "Low"),
        (9, "ACCESS_KEY", "left(c_mktsegment, 4)", "Medium"),
    ]
    return " UNION ALL ".join(
        f"SELECT c_custkey AS file_id, 'app' || c_custkey::VARCHAR || '/prod.env' AS file, {n}::INTEGER AS line, "
        f"{lit(k)} AS key, {v} AS value, {mask(v)} AS value_preview, {lit(c)} AS confidence FROM customer"
        for n, k, v, c in rows)


def _entropy_tokens(s, d):
    return sec.high_entropy_tokens(_docs(s, d), 3.0).select("file_id", "token", F.round("entropy", 6).alias("entropy"))


_LANGUAGE = f"""CASE WHEN contains(text, 'def ') AND {any_of('text', ['self', 'import '])} THEN 'python'
 WHEN contains(text, '{{') AND {any_of('text', ['function ', 'var ', 'const ', 'let '])} THEN 'javascript'
 WHEN contains(text, '<?php') OR (contains(text, '$') AND contains(text, 'function ')) THEN 'php'
 WHEN {any_of('text', ['public class ', 'private class ', 'public static void '])} THEN 'java'
 WHEN contains(text, '#include') AND {any_of('text', ['int main', 'void main'])} THEN 'c'
 WHEN contains(text, '<') AND contains(text, '>') AND {any_of('text', ['</', '/>'])} THEN 'html'
 ELSE 'unknown' END"""


def _language_of(s, d):
    files = tables.page_files(s, d).select("file_id", "path", "text").unionByName(
        _both(s, d).select("file_id", "path", "text"))
    return files.select("file_id", "path", sec.detect_code_language(F.col("text")).alias("language"))


# Searches over the documents: with one word, with alternatives, without case,
# and without any three characters that a match must hold.
SEARCHES = [r"secret\w* \d", r"(token|pass)\s*[:=]", r"(?i)gmail", r"\d{3}-\d{2}"]


def _indexed(s, files, block_bytes=256 << 10):
    return trigrams.write_index(files, scratch_folder(s, "index"), block_bytes)


def _code_index(s, d):
    poly = tables.polyglot_files(s, d).withColumn("file_id", -1 - F.col("file_id"))
    return _indexed(s, tables.flow_files(s, d).unionByName(poly))


def _costs(s, d):
    index = _indexed(s, _docs(s, d))
    out = None
    for pattern in SEARCHES:
        row = trigrams.search_cost(index, pattern)
        out = row if out is None else out.unionByName(row)
    return out


def _condition_sql(condition) -> str:
    """A trigram condition as a test of the folded text."""
    if condition is True:
        return "TRUE"
    if isinstance(condition, str):
        return f"contains(folded, {lit(condition)})"
    return "(" + f" {condition[0].upper()} ".join(_condition_sql(c) for c in condition[1]) + ")"


_COSTS_SQL = " UNION ALL ".join(
    f"SELECT {lit(p)} AS pattern, {c is not True} AS indexed, count(*) AS files, sum(size)::BIGINT AS bytes, "
    f"count(*) FILTER ({_condition_sql(c)}) AS candidates, coalesce(sum(size) FILTER ({_condition_sql(c)}), 0)::BIGINT AS candidate_bytes "
    f"FROM (SELECT size, lower(upper(text)) AS folded FROM ({DOCS}))"
    for p in SEARCHES for c in [trigrams.condition_of(p)])


CHECKS = {
    "match_rules": Check(_match_rules, _by_extension_sql()),
    "match_rules_in_one_pass": Check(_match_rules_in_one_pass, _by_extension_sql()),
    "match_lines_once": Check(
        _lines_once,
        f"WITH {pattern_found(DOCS)} SELECT file_id, rule_id, match_no, line, match, {CODE_LINE} AS code, {CONTEXT} AS context FROM found"),
    "match_line_numbers": Check(
        lambda s, d: _general(s, d, code=False).select("file_id", "rule_id", "match_no", "line"),
        f"WITH {pattern_found(DOCS)} SELECT file_id, rule_id, match_no, line FROM found"),
    "match_code_line": Check(
        lambda s, d: _general(s, d).select("file_id", "rule_id", "match_no", "code"),
        f"WITH {pattern_found(DOCS)} SELECT file_id, rule_id, match_no, {CODE_LINE} AS code FROM found"),
    "match_context": Check(
        lambda s, d: _general(s, d, context=True).select("file_id", "rule_id", "match_no", "context"),
        f"WITH {pattern_found(DOCS)} SELECT file_id, rule_id, match_no, {CONTEXT} AS context FROM found"),
    "match_context_rows": Check(
        lambda s, d: _general(s, d, code=False, context_rows=True).select(
            "file_id", "rule_id", "match_no", F.inline("context_rows")),
        f"""WITH {pattern_found(DOCS)} SELECT file_id, rule_id, match_no, i::INTEGER AS line_num, lines[i] AS content, i = line AS is_match
        FROM found, unnest(range(greatest(line - 2, 1), least(line + 2, len(lines)) + 1)) AS t(i)"""),
    "rules_for_language": Check(
        lambda s, d: search.rules_for_language(tables.page_files(s, d).unionByName(tables.polyglot_files(s, d))),
        f"""WITH {values('r', ['rule_id', 'grp'], [(r[0], r[1]) for r in pattern_rows(BY_EXTENSION)])},
        f AS (SELECT file_id, path FROM ({PAGES}) UNION ALL SELECT file_id, path FROM ({POLYGLOT}))
        SELECT file_id, path, grp AS rule_group, rule_id FROM f JOIN r ON r.grp = {_GROUP}"""),
    "search_pattern": Check(
        lambda s, d: search.search_pattern(
            _docs(s, d).unionByName(tables.conversation_files(s, d)), r"^[A-Z][a-z]+ \w+\.$|\d{4,}"),
        rf"""WITH {found(f"SELECT file_id, path, text FROM ({DOCS}) UNION ALL SELECT file_id, path, text FROM ({CONVERSATIONS})",
                         ["rule_id", "pattern"], [("search", r"^[A-Z][a-z]+ [\pL\pN_]+\.$|\d{4,}")], flags="(?m)")}
        SELECT file_id, path AS file, match_no, line, match, {CONTEXT} AS context, 'pattern_match' AS type FROM found"""),
    "search_index": Check(
        lambda s, d: search.search_index(_indexed(s, _docs(s, d)), SEARCHES[1]).unionByName(
            search.search_index(_indexed(s, tables.conversation_files(s, d)), SEARCHES[3])),
        " UNION ALL ".join(
            f"""SELECT * FROM (WITH {found(f"SELECT file_id, path, text FROM ({corpus})", ["rule_id", "pattern"], [("search", p)], flags="(?m)")}
        SELECT file_id, path AS file, match_no, line, match, {CONTEXT} AS context, 'pattern_match' AS type FROM found)"""
            for corpus, p in ((DOCS, SEARCHES[1]), (CONVERSATIONS, SEARCHES[3])))),
    "search_index_cost": Check(_costs, _COSTS_SQL),
    "run_query_on_index": Check(
        lambda s, d: search.run_query_on_index(_code_index(s, d)).select(
            "file_id", "file", "query_id", "line_start", "line_end", "match", "context", "severity"),
        f"""WITH {query_found(f"SELECT file_id, path, text FROM ({FLOW}) UNION ALL SELECT -1 - file_id, path, text FROM ({POLYGLOT})")} SELECT file_id, path AS file, query_id,
        line AS line_start, (line + length(match) - length(replace(match, chr(10), '')))::INTEGER AS line_end, match, {CONTEXT} AS context, severity FROM found"""),
    "search_functions": Check(
        lambda s, d: search.search_functions(
            tables.flow_files(s, d).unionByName(tables.polyglot_files(s, d)),
            ["helper", "inner", "execute", "open", "eval", "include"]),
        f"""WITH {found(f"SELECT file_id, path, text FROM ({FLOW}) UNION ALL SELECT file_id, path, text FROM ({POLYGLOT})",
                        ["function", "form", "pattern"], _function_rows(["helper", "inner", "execute", "open", "eval", "include"]), flags="(?m)")},
        best AS (SELECT *, min(form) OVER (PARTITION BY file_id, path, function) AS first_form FROM found)
        SELECT file_id, path AS file, function, line, match, {CONTEXT} AS context, 'function_match' AS type FROM best WHERE form = first_form"""),
    "run_query": Check(
        lambda s, d: search.run_query(tables.flow_files(s, d), "py-eval-exec").select(
            "file_id", "file", "query_id", "line_start", "line_end", "match", "context", "severity"),
        f"""WITH {query_found(FLOW, 'py-eval-exec')} SELECT file_id, path AS file, query_id, line AS line_start,
        (line + length(match) - length(replace(match, chr(10), '')))::INTEGER AS line_end, match, {CONTEXT} AS context, severity FROM found"""),
    "run_all_queries": Check(
        lambda s, d: search.run_all_queries(tables.flow_files(s, d).unionByName(tables.polyglot_files(s, d))).select(
            "file_id", "file", "line", "type", "severity", "description", "code", "query_id", "phase"),
        f"""WITH {query_found(f"SELECT file_id, path, text FROM ({FLOW}) UNION ALL SELECT file_id, path, text FROM ({POLYGLOT})")}
        SELECT file_id, path AS file, line, 'Custom Query: ' || name AS type, severity,
        'Custom query ''' || name || ''' matched: ' || match AS description, match AS code, query_id, 'query' AS phase FROM found"""),
    "query_dangerous_eval": Check(
        lambda s, d: search.query_dangerous_eval(tables.flow_files(s, d)).select(
            "file_id", "file", "query_id", "line_start", "line_end", "match", "severity"),
        f"""WITH {found(FLOW, ['rule_id', 'pattern'], [('dangerous_eval', DANGEROUS_EVAL_PATTERN)])}
        SELECT file_id, path AS file, rule_id AS query_id, line AS line_start, line AS line_end, match, 'High' AS severity FROM found"""),
    "query_result_counts": Check(
        lambda s, d: search.query_result_counts(
            search.run_query(tables.flow_files(s, d)), catalogues.query_table(s)),
        f"""WITH {query_found(FLOW)}, q AS (SELECT query_id, count(*) AS n FROM found GROUP BY 1),
        {values('names', ['id', 'name'], [(r[0], r[1]) for r in SAVED_QUERY_ROWS])}
        SELECT id AS query_id, name AS query_name, coalesce(n, 0) AS result_count FROM names LEFT JOIN q ON id = query_id"""),
    "create_query_id": Check(
        lambda s, d: search.create_query_ids(_new_queries(s, d), _taken(s, d)).withColumn("tags", F.array_join("tags", ",")),
        """WITH used AS (SELECT DISTINCT replace(p_name, ' ', '-') AS base, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 2 END AS no FROM part WHERE p_size = 50),
        ranked AS (SELECT *, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part),
        free AS (SELECT base, no, row_number() OVER (PARTITION BY base ORDER BY no) AS k FROM
          (SELECT base, no FROM (SELECT DISTINCT base FROM ranked), range(0, (SELECT max(k) + 3 FROM ranked)) AS t(no)
           WHERE (base, no) NOT IN (SELECT base, no FROM used)))
        SELECT p_partkey AS seq, p_name AS name, CASE WHEN no = 0 THEN base ELSE base || '-' || no::VARCHAR END AS query_id,
          CASE WHEN p_size > 25 THEN p_brand ELSE 'Custom query: ' || p_name END AS description,
          'Medium' AS severity, 'regex' AS type, 'custom' AS tags, 'python' AS language, 'x' AS pattern
        FROM ranked JOIN free USING (base, k)"""),
    "scan_sensitive": Check(
        lambda s, d: _secrets(s, d).select("file_id", "file", "rule_id", "category", "match_no", "line", "match", "context"),
        f"WITH {_SECRETS} SELECT file_id, file, rule_id, category, match_no, line, match, context FROM secrets"),
    "sensitive_file_flag": Check(
        lambda s, d: tables.page_files(s, d).select("file_id", "path").unionByName(
            tables.env_table_files(s, d).select("file_id", "path")).select(
            "file_id", "path", sec.is_sensitive_file(F.col("path")).alias("is_sensitive_file")),
        f"""WITH f AS (SELECT file_id, path FROM ({PAGES}) UNION ALL SELECT c_custkey, 'app' || c_custkey::VARCHAR || '/prod.env' FROM customer)
        SELECT file_id, path, regexp_matches(path, {_SENSITIVE}) AS is_sensitive_file FROM f"""),
    "false_positive_flag": Check(
        lambda s, d: _secrets(s, d).select("file_id", "rule_id", "match_no", "probable_false_positive"),
        f"WITH {_SECRETS} SELECT file_id, rule_id, match_no, probable_false_positive FROM secrets"),
    "drop_false_positives": Check(
        lambda s, d: sec.drop_false_positives(_secrets(s, d)).select("file_id", "rule_id", "match_no", "line"),
        f"WITH {_SECRETS} SELECT file_id, rule_id, match_no, line FROM secrets WHERE NOT probable_false_positive"),
    "secret_severity": Check(
        lambda s, d: _secrets(s, d).select("file_id", "rule_id", "match_no", "category", "severity"),
        f"WITH {_SECRETS} SELECT file_id, rule_id, match_no, category, severity FROM secrets"),
    "secret_confidence": Check(
        lambda s, d: sec.as_secret_rows(_secrets(s, d)).drop("context"),
        f"""WITH {_SECRETS} SELECT file_id, file, line, category AS key, match, '*****' AS value_preview,
        severity AS confidence, is_sensitive_file FROM secrets"""),
    "env_secrets": Check(
        lambda s, d: sec.env_secrets(tables.env_table_files(s, d)).select("file_id", "file", "line", "key"),
        f"SELECT file_id, file, line, key FROM ({_env_sql()})"),
    "env_confidence": Check(
        lambda s, d: sec.env_secrets(tables.env_table_files(s, d)).select("file_id", "key", "confidence"),
        f"SELECT file_id, key, confidence FROM ({_env_sql()})"),
    "mask_value": Check(
        lambda s, d: sec.env_secrets(tables.env_table_files(s, d)).select("file_id", "key", "value_preview"),
        f"SELECT file_id, key, value_preview FROM ({_env_sql()})"),
    "findings_by_file": Check(
        lambda s, d: sec.findings_by_file(_secrets(s, d)).select(
            "file_id", "file", "chunk", "n",
            F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["line"].cast("string"), x["rule_id"], x["match"])), "; ").alias("findings")),
        f"""WITH {_SECRETS} SELECT file_id, file, (match_no // 1000)::INTEGER AS chunk, count(*)::INTEGER AS n,
        string_agg(line::VARCHAR || ':' || rule_id || ':' || match, '; ' ORDER BY line, rule_id, match_no) AS findings FROM secrets GROUP BY 1, 2, 3"""),
    "secret_severity_breakdown": Check(
        lambda s, d: sec.secret_severity_breakdown(_secrets(s, d)),
        f"""WITH {_SECRETS} SELECT count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium,
        count(*) FILTER (severity = 'Low') AS low, count(*) AS total FROM secrets"""),
    "high_entropy_tokens": Check(
        _entropy_tokens,
        f"""WITH t AS (SELECT doc_id AS file_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{20,}}')) AS token FROM documents),
        n AS (SELECT file_id, token, row_number() OVER () AS id FROM t),
        c AS (SELECT file_id, token, id, unnest(string_split(token, '')) AS ch FROM n),
        p AS (SELECT file_id, token, id, ch, count(*) * 1.0 / length(token) AS p FROM c WHERE ch <> '' GROUP BY 1, 2, 3, 4)
        SELECT file_id, token, round(-sum(p::DOUBLE * log2(p::DOUBLE)), 6) AS entropy FROM p GROUP BY file_id, token, id HAVING -sum(p::DOUBLE * log2(p::DOUBLE)) > 3.0"""),
    "detect_code_language": Check(
        _language_of,
        f"WITH f AS (SELECT file_id, path, text FROM ({PAGES}) UNION ALL ({_BOTH})) SELECT file_id, path, {_LANGUAGE} AS language FROM f"),
}


def _union_files(s, d):
    return _docs(s, d).unionByName(tables.env_table_files(s, d))


# Pattern secrets are searched in the .env files as well: the oracle unions
# both corpora, then adds the key rows.
_ENV_TEXT = ("SELECT c_custkey AS file_id, 'app' || c_custkey::VARCHAR || '/prod.env' AS path, '# settings of ' || c_name || chr(10) || chr(10) || "
             "'DB_PASSWORD=' || c_name || chr(10) || '  api_key = k=' || printf('%.2f', c_acctbal) || '  ' || chr(10) || 'AUTH_URL=http://h/' || c_custkey::VARCHAR "
             "|| chr(10) || 'PIN_HASH=' || c_custkey::VARCHAR || chr(10) || 'SECRET=' || chr(10) || 'SEGMENT=' || c_mktsegment || chr(10) || "
             "'ACCESS_KEY=' || left(c_mktsegment, 4) || chr(10) || 'no pair here' AS text FROM customer")
_UNION_FOUND = secret_found(f"SELECT file_id, path, text FROM ({DOCS}) UNION ALL ({_ENV_TEXT})")
CHECKS["secrets_union"] = Check(
    lambda s, d: sec.all_secrets(_union_files(s, d)).select(
        "file_id", "file", "line", "key", "match", "value_preview", "confidence", "is_sensitive_file"),
    f"""WITH {_UNION_FOUND}
    SELECT file_id, path AS file, line, category AS key, match, '*****' AS value_preview, {_CATEGORY_SEVERITY} AS confidence,
      regexp_matches(path, {_SENSITIVE}) AS is_sensitive_file FROM found WHERE NOT regexp_matches(lines[line], {_FP})
    UNION ALL SELECT file_id, file, line, key, NULL, value_preview, confidence, NULL FROM ({_env_sql()})""")

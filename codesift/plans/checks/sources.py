"""Checks of the sources, sinks and filters (S and F keys)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codesift.catalog.languages import SUPPORTED_EXTENSIONS
from codesift.catalog.structural import APPLIED_PATTERN_TYPES, STRUCTURAL_RULE_ROWS
from codesift.functions import text as tx
from codesift.operators import deps, report, search, select
from codesift.plans.checks.common import (
    CODE, CODE_LINE, DOCS, PAGES, POLYGLOT, Check, base_name, ext, lit, pattern_found, pattern_rows, query_found, values)
from codesift.schemas import FINDINGS
from codesift.session import durable, ensure_checkpoint_dir, scratch_folder
from codesift.sources import catalogues, corpus, sinks, tables
from codesift.sources.tree import write_tree


def _contents(spark, sf):
    """Documents as bytes, some with a bad byte in front or at the end."""
    text = F.col("text").cast("binary")
    bad, k = F.unhex(F.lit("FF")), F.col("file_id") % 5
    return tables.document_files(spark, sf).withColumn(
        "content", F.when(k == 0, F.concat(bad, text)).when(k == 1, F.concat(text, bad)).otherwise(text))


def doc_findings(spark, sf):
    return search.pattern_findings(tables.document_files(spark, sf), ["generic", "sensitive_data"])


def _round_trip(spark, sf):
    """Write the findings as JSON below the shared folder and read them back."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/findings-{uuid.uuid4().hex}"
    sinks.write_findings_json(doc_findings(spark, sf), path)
    back = spark.read.schema(FINDINGS).json(path)
    return back.select("file_id", "file", "line", "rule_id", "match_no", "severity", "code")


# Size cap of the tree that is written and read back.
_TREE_CAP = 6000


def _tree(spark, sf):
    """The documents as a tree of files, some hidden or in hidden folders, read
    back with everything that is in it."""
    docs = tables.document_files(spark, sf)
    k = F.col("file_id")
    folder = F.when(k % 5 == 0, F.lit(".config/")).when(k % 5 == 1, F.lit("_gen/deep/")).otherwise(F.lit(""))
    name = F.when(k % 7 == 0, F.lit(".")).when(k % 7 == 1, F.lit("_")).otherwise(F.lit("f"))
    path = F.concat(F.regexp_extract("path", "^([^/]*)/", 1), F.lit("/"), folder, name, k.cast("string"), "ext")
    root = scratch_folder(spark, "tree")
    written = durable(write_tree(docs.select(path.alias("path"), "text"), root))
    files = corpus.read_corpus_in_full(spark, root, _TREE_CAP)
    rows = files.withColumn("path", F.element_at(F.split("path", root.rsplit("/", 1)[1] + "/"), -1))
    # What was written and what came back, side by side.
    return written.join(rows, "path", "full").select(
        "path", "length", "ext", "size", F.length("text").cast("long").alias("chars"), "error")


_TREE_SQL = f"""WITH t AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN '.config/' WHEN doc_id % 5 = 1 THEN '_gen/deep/' ELSE '' END AS folder,
  CASE WHEN doc_id % 7 = 0 THEN '.' WHEN doc_id % 7 = 1 THEN '_' ELSE 'f' END AS mark, octet_length(encode(text))::BIGINT AS bytes FROM documents)
SELECT source || '/' || folder || mark || doc_id || '.' || lang AS path, bytes AS length, '.' || lang AS ext, bytes AS size,
  CASE WHEN bytes <= {_TREE_CAP} THEN length(text)::BIGINT END AS chars, CASE WHEN bytes > {_TREE_CAP} THEN 'too large' END AS error FROM t"""


def _rules_per_language(spark, sf):
    rules = catalogues.rules_table(spark).groupBy("language").agg(
        F.countDistinct("rule_id").alias("n_rules"), F.count("*").alias("n_patterns"),
        F.count_if("applied").alias("n_applied"))
    files = tables.polyglot_files(spark, sf).groupBy("ext").agg(F.count("*").alias("n_files"))
    return rules.join(files, catalogues.extension_of_language(F.col("language")) == F.col("ext"), "left").select(
        "language", "n_rules", "n_patterns", "n_applied", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def _patterns_per_group(spark, sf):
    files = tables.polyglot_files(spark, sf).groupBy(search.rule_group(F.col("path")).alias("lang")).agg(
        F.count("*").alias("n_files"))
    rules = catalogues.pattern_table(spark).groupBy("lang").agg(
        F.count("*").alias("n_rules"), F.countDistinct("cwe").alias("n_cwe"))
    return rules.join(files, "lang", "left").select("lang", "n_rules", "n_cwe", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def _queries_per_severity(spark, sf):
    """Saved queries by severity with the matches their rows lead to."""
    queries = catalogues.query_table(spark)
    hits = search.run_query(tables.polyglot_files(spark, sf), None, queries).groupBy("severity").agg(
        F.count("*").alias("n_matches"))
    counts = queries.groupBy("severity").agg(F.count("*").alias("n_queries"), F.sum(F.size("tags")).alias("n_tags"))
    return counts.join(hits, "severity", "left")


def _advisories_per_language(spark, sf):
    a = catalogues.advisory_table(spark).groupBy("language").agg(F.count("*").alias("n_advisories"))
    d = deps.find_manifests(tables.manifest_files(spark, sf)).groupBy("language").agg(F.count("*").alias("n_manifests"))
    return a.join(d, "language", "left").select("language", "n_advisories", F.coalesce("n_manifests", F.lit(0)).alias("n_manifests"))


def _pages(spark, sf):
    return tables.page_files(spark, sf)


_FOUND_DOCS = pattern_found(DOCS)
_FINDING = f"SELECT file_id, path AS file, line, rule_id, match_no, severity, {CODE_LINE} AS code, type, description FROM found"
_RULE_ROWS = [(language, rid, language == "python" and p["type"] in APPLIED_PATTERN_TYPES and (p["type"] != "assignment" or "variable_name" in p))
              for language, rid, _n, _d, _s, patterns, _m in STRUCTURAL_RULE_ROWS for p in patterns]
_MANIFEST_LANGUAGES = values("m", ["i", "language"], [
    (i, lang) for i, lang in enumerate(
        ["python"] * 5 + ["javascript"] * 4 + ["php"] * 2 + ["java"] * 3 + ["dotnet"] * 3 + ["go"] * 4)])
_EXTS = ", ".join(lit(e) for e in SUPPORTED_EXTENSIONS)
_RANKS = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
_REPORT_RANK = "CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END"

CHECKS = {
    "corpus_files": Check(
        lambda s, d: tables.document_files(s, d).select("file_id", "path", "ext", "size"),
        f"SELECT file_id, path, {ext('path')} AS ext, size FROM ({DOCS})"),
    "corpus_tree": Check(_tree, _TREE_SQL),
    "corpus_decode": Check(
        lambda s, d: _contents(s, d).select("file_id", F.md5(corpus.decode_text(F.col("content")).cast("binary")).alias("digest")),
        f"SELECT file_id, md5(CASE file_id % 5 WHEN 0 THEN chr(65533) || text WHEN 1 THEN text || chr(65533) ELSE text END) AS digest FROM ({DOCS})"),
    "text_only": Check(
        lambda s, d: _contents(s, d).where(corpus.is_text(F.col("content"))).select("file_id", "path"),
        f"SELECT file_id, path FROM ({DOCS}) WHERE NOT (file_id % 5 = 0 OR (file_id % 5 = 1 AND length(text) < 1024))"),
    "size_cap": Check(
        lambda s, d: corpus.size_cap(tables.document_files(s, d), 4096).select("file_id", "size"),
        f"SELECT file_id, size FROM ({DOCS}) WHERE size <= 4096"),
    "max_files_cap": Check(
        lambda s, d: corpus.max_files_cap(tables.document_files(s, d), 150).select("file_id", "path"),
        f"SELECT file_id, path FROM ({DOCS}) ORDER BY path, file_id LIMIT 150"),
    "rules_table": Check(_rules_per_language, f"""WITH {values('r', ['language', 'rule_id', 'applied'], [(a, b, int(c)) for a, b, c in _RULE_ROWS])},
        f AS (SELECT {ext('path')} AS e, count(*) AS n_files FROM ({POLYGLOT}) GROUP BY 1),
        c AS (SELECT language, count(DISTINCT rule_id) AS n_rules, count(*) AS n_patterns, sum(applied)::BIGINT AS n_applied FROM r GROUP BY 1)
        SELECT language, n_rules, n_patterns, n_applied, coalesce(n_files, 0) AS n_files FROM c
        LEFT JOIN f ON e = CASE language WHEN 'javascript' THEN '.js' ELSE '.py' END"""),
    "pattern_table": Check(_patterns_per_group, """WITH r(lang, n_rules, n_cwe) AS (VALUES
        ('py', 9, 9), ('js', 8, 7), ('php', 7, 7), ('java', 8, 8), ('c', 7, 7), ('cpp', 5, 5), ('go', 5, 5), ('rb', 3, 3),
        ('config', 2, 2), ('docker', 2, 1), ('generic', 8, 5), ('sensitive_data', 9, 2)),
        f AS (SELECT CASE WHEN e IN ('py','js','php','java','c','cpp','go','rb') THEN e ELSE 'generic' END AS lang, count(*) AS n_files
          FROM (SELECT substr(%s, 2) AS e FROM (%s)) GROUP BY 1)
        SELECT lang, n_rules::BIGINT AS n_rules, n_cwe::BIGINT AS n_cwe, coalesce(n_files, 0) AS n_files FROM r LEFT JOIN f USING (lang)"""
        % (ext("path"), POLYGLOT)),
    "query_table": Check(_queries_per_severity, f"""WITH {query_found(POLYGLOT)},
        h AS (SELECT severity, count(*) AS n_matches FROM found GROUP BY 1),
        c(severity, n_queries, n_tags) AS (VALUES ('High', 8, 18), ('Medium', 2, 4))
        SELECT severity, n_queries::BIGINT AS n_queries, n_tags::BIGINT AS n_tags, n_matches FROM c LEFT JOIN h USING (severity)"""),
    "advisory_table": Check(_advisories_per_language, f"""WITH {_MANIFEST_LANGUAGES},
        f AS (SELECT language, count(*) AS n_manifests FROM part JOIN m ON p_partkey % {len(tables.MANIFESTS)} = i GROUP BY 1),
        a(language, n) AS (VALUES ('python', 3), ('javascript', 2), ('java', 1), ('php', 1), ('dotnet', 1), ('go', 1), ('ruby', 1))
        SELECT language, n::BIGINT AS n_advisories, coalesce(n_manifests, 0) AS n_manifests FROM a LEFT JOIN f USING (language)"""),
    "write_findings_json": Check(
        _round_trip, f"WITH {_FOUND_DOCS} SELECT file_id, path AS file, line, rule_id, match_no, severity, {CODE_LINE} AS code FROM found"),
    "supported_files": Check(
        lambda s, d: select.supported_files(_pages(s, d)).select("file_id", "path", "ext"),
        f"SELECT file_id, path, {ext('path')} AS ext FROM ({PAGES}) WHERE NOT starts_with({base_name('path')}, '.') AND {ext('path')} IN ({_EXTS})"),
    "env_files": Check(
        lambda s, d: select.env_files(tables.env_table_files(s, d).unionByName(tables.code_files(s, d))).select("file_id", "path"),
        f"SELECT c_custkey AS file_id, 'app' || c_custkey::VARCHAR || '/prod.env' AS path FROM customer UNION ALL SELECT file_id, path FROM ({CODE})"),
    "language_dim": Check(
        lambda s, d: select.with_language(_pages(s, d).unionByName(tables.polyglot_files(s, d))).select("file_id", "path", "language"),
        f"""WITH {values('dim', ['e', 'language'], list(SUPPORTED_EXTENSIONS.items()))},
        f AS (SELECT file_id, path FROM ({PAGES}) UNION ALL SELECT file_id, path FROM ({POLYGLOT}))
        SELECT file_id, path, language FROM f LEFT JOIN dim ON e = {ext('path')}"""),
    "exclude_paths": Check(
        lambda s, d: select.exclude_paths(_pages(s, d), r"//blog\.|/de/").select("file_id", "path"),
        rf"SELECT file_id, path FROM ({PAGES}) WHERE NOT regexp_matches(path, '//blog\.|/de/')"),
    "exclude_dirs_files": Check(
        lambda s, d: select.exclude_dirs_files(_pages(s, d), ["fr", "node_modules"], ["*.html", "1?"]).select("file_id", "path"),
        rf"""SELECT file_id, path FROM ({PAGES}) WHERE NOT list_has_any(string_split(path, '/')[:-2], ['fr', 'node_modules'])
        AND NOT regexp_matches({base_name('path')}, '^.*\.html$|^1.$')"""),
    "severity_threshold": Check(
        lambda s, d: select.severity_threshold(doc_findings(s, d), "Medium").select("file_id", "rule_id", "line", "severity"),
        f"WITH {_FOUND_DOCS} SELECT file_id, rule_id, line, severity FROM found WHERE {_RANKS} >= 2"),
    "suppress_patterns": Check(
        lambda s, d: select.suppress_patterns(doc_findings(s, d), [r"^token", r"\d{3}\.\d"]).select("file_id", "rule_id", "line", "code"),
        rf"WITH {_FOUND_DOCS}, c AS ({_FINDING}) SELECT file_id, rule_id, line, code FROM c WHERE NOT regexp_matches(code, '^token') AND NOT regexp_matches(code, '\d{{3}}\.\d')"),
    "findings_filter": Check(
        lambda s, d: select.findings_filter(doc_findings(s, d), "Src1", "High").select("file_id", "file", "rule_id", "line"),
        f"""WITH {_FOUND_DOCS} SELECT file_id, path AS file, rule_id, line FROM found WHERE severity = 'High'
        AND contains(lower(concat_ws(' ', severity, type, path, line::VARCHAR, description)), 'src1')"""),
    "findings_view": Check(
        lambda s, d: select.findings_view(doc_findings(s, d)),
        f"""WITH {_FOUND_DOCS} SELECT row_number() OVER (ORDER BY {_REPORT_RANK}, path, file_id, line, rule_id, match_no) AS row_no,
        severity, type, {base_name('path')} AS file_name, path AS short_path, line,
        CASE WHEN length(description) > 50 THEN substr(description, 1, 50) || '...' ELSE description END AS description FROM found"""),
    "html_escape": Check(
        lambda s, d: _pages(s, d).select("file_id", tx.html_escape(F.col("text")).alias("html")),
        f"""SELECT file_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html
        FROM ({PAGES})"""),
}

"""Checks of the dependency operators (G keys) and of F9."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.catalog.advisories import ADVISORY_ROWS
from codesift.functions.versions import version_compare
from codesift.operators import advisories, deps, select
from codesift.plans.checks.common import Check, lit, values
from codesift.sources import catalogues, tables

_N = len(tables.MANIFESTS)
_V = "(p_partkey % 7)::VARCHAR || '.' || (p_partkey % 25)::VARCHAR || '.' || (p_partkey % 30)::VARCHAR"
_PY, _JS, _PHP, _JAVA, _NET, _GO = "python", "javascript", "php", "java", "dotnet", "go"
_LOG4J, _GIN = "org.apache.logging.log4j:log4j-core", "github.com/gin-gonic/gin"

# What each manifest declares: (manifest, name, version, constraint, language,
# source); N and V stand for the part's name and version.
_EXPECTED = [
    (0, "N", "V", "==", _PY, "requirements.txt"), (0, "requests", "V", "<=", _PY, "requirements.txt"),
    (0, "urllib3", "", "", _PY, "requirements.txt"), (0, "flask", "2.0 ; extra", "~=", _PY, "requirements.txt"),
    (1, "N", "V", ">=", _PY, "setup.py"), (1, "jinja2", "V", "==", _PY, "setup.py"), (1, "six", "", "", _PY, "setup.py"),
    (2, "N", "V", "==", _PY, "pyproject.toml (poetry)"), (2, "urllib3", "V", "==", _PY, "pyproject.toml (poetry)"),
    (2, "local", "", "", _PY, "pyproject.toml (poetry)"), (2, "requests", "V", ">=", _PY, "pyproject.toml (PEP 621)"),
    (2, "x[y]", "2", "<", _PY, "pyproject.toml (PEP 621)"),
    (3, "requests", "V", "==", _PY, "Pipfile (packages)"), (3, "N", "", "", _PY, "Pipfile (packages)"),
    (3, "pytest", "*", "==", _PY, "Pipfile (dev-packages)"),
    (4, "requests", "V", "==", _PY, "Pipfile.lock (default)"), (4, "N", "", "==", _PY, "Pipfile.lock (develop)"),
    (5, "lodash", "^V", "^", _JS, "package.json (dependencies)"), (5, "N", "V", "==", _JS, "package.json (dependencies)"),
    (5, "jquery", "V", "==", _JS, "package.json (devDependencies)"),
    (6, "jquery", "V", "==", _JS, "package-lock.json"), (6, "N", "1.0", "==", _JS, "package-lock.json"),
    (7, "lodash", "V", "==", _JS, "npm-shrinkwrap.json"),
    (8, "lodash", "V", "==", _JS, "yarn.lock"), (8, "N", "1.0.0", "==", _JS, "yarn.lock"),
    (9, "symfony/security-http", "V", "==", _PHP, "composer.json (require)"), (9, "N", "*", "==", _PHP, "composer.json (require-dev)"),
    (10, "symfony/security-http", "vV", "==", _PHP, "composer.lock"), (10, "N", "", "==", _PHP, "composer.lock"),
    (11, _LOG4J, "V", "==", _JAVA, "pom.xml"), (11, "g:N", "", "==", _JAVA, "pom.xml"),
    (12, _LOG4J, "V", "==", _JAVA, "build.gradle"), (12, "g:N", "1.0", "==", _JAVA, "build.gradle"),
    (13, "g:N", "V", "==", _JAVA, "build.gradle.kts"),
    (14, "Newtonsoft.Json", "V", "==", _NET, "app.csproj"),
    (15, "Newtonsoft.Json", "V", "==", _NET, "packages.config"),
    (16, "Newtonsoft.Json", "V", "==", _NET, "project.json"), (16, "N", "2", "==", _NET, "project.json"),
    (17, _GIN, "V", "==", _GO, "go.mod"), (17, "example.com/N", "1.2.3", "==", _GO, "go.mod"), (17, "other.org/b", "0.1", "==", _GO, "go.mod"),
    (18, _GIN, "vV", "==", _GO, "go.sum"),
    (19, _GIN, "V", "==", _GO, "Gopkg.toml"), (19, "example.com/N", "V", "==", _GO, "Gopkg.toml"),
    (20, _GIN, "vV", "==", _GO, "Gopkg.lock"),
]


def _fill(text: str, mark: str, expr: str) -> str:
    """``text`` with its ``mark`` (a prefix or the whole) replaced by SQL."""
    if text == mark:
        return expr
    if text.endswith(mark) and text[: -len(mark)] in ("^", "v", "g:", "example.com/"):
        return f"{lit(text[:-len(mark)])} || {expr}"
    return lit(text)


def _deps_sql(kinds: list[int] | None = None) -> str:
    rows = [r for r in _EXPECTED if kinds is None or r[0] in kinds]
    path = f"'proj' || p_partkey::VARCHAR || '/' || CASE p_partkey % {_N} " + " ".join(
        f"WHEN {i} THEN {lit(n)}" for i, (n, _) in enumerate(tables.MANIFESTS)) + " END"
    name = "replace(p_name, ' ', '-')"
    return " UNION ALL ".join(
        f"SELECT p_partkey AS file_id, {path} AS path, {_fill(n, 'N', name)} AS name, {_fill(v, 'V', f'({_V})')} AS version, "
        f"{lit(c)} AS version_constraint, {lit(lang)} AS language, {lit(src)} AS source FROM part WHERE p_partkey % {_N} = {i}"
        for i, n, v, c, lang, src in rows)


def _reader(formats: list[str], kinds: list[int]) -> Check:
    return Check(
        lambda s, d: deps.read_dependencies(tables.manifest_files(s, d), formats).drop("dep_no"), _deps_sql(kinds))


def _all_deps(s, d):
    return deps.read_dependencies(tables.manifest_files(s, d))


def _hits(s, d, mode="any"):
    return deps.vulnerable_deps(_all_deps(s, d), catalogues.advisory_table(s), mode)


_NUM = "[try_cast(x AS INTEGER) for x in string_split(ltrim(version, 'v'), '.')]"
# Affected versions as conditions on the three numbers of a version.
_AFFECTED = {
    "CVE-2018-18074": "n <= [2, 19, 1]", "CVE-2019-11324": "n < [1, 24, 2]", "CVE-2021-23727": "n < [2, 11, 3]",
    "CVE-2019-11358": "n < [3, 4, 0]", "CVE-2021-23337": "NOT starts_with(version, '^') AND n < [4, 17, 21]",
    "CVE-2021-44228": "TRUE", "CVE-2019-10910": "n < [4, 3, 8]", "CVE-2020-1108": "n < [12, 0, 3]",
    "CVE-2020-36067": "n < [1, 6, 0]", "CVE-2020-8165": "n < [6, 0, 4]",
}
_HITS = f"""{values('adv', ['advisory_id', 'language', 'package', 'severity', 'title', 'patched'], [(a[0], a[1], a[2], a[5], a[6], a[4][0]) for a in ADVISORY_ROWS])},
deps AS ({_deps_sql()}),
hits AS (SELECT deps.*, advisory_id, package, severity, title, patched FROM
  (SELECT *, {_NUM} AS n FROM deps) AS deps JOIN adv ON adv.language = deps.language AND adv.package = deps.name
  WHERE version = '' OR CASE advisory_id {' '.join(f"WHEN {lit(k)} THEN {c}" for k, c in _AFFECTED.items())} END)"""
_FIRST = "uniq AS (SELECT *, row_number() OVER (PARTITION BY advisory_id, package, version ORDER BY path, file_id) AS rn FROM hits), firsts AS (SELECT * FROM uniq WHERE rn = 1)"


def _unique(s, d):
    return deps.dedup_advisories(_hits(s, d))


def _versions(s, d):
    k = F.col("p_partkey")
    v = F.concat_ws(".", *[F.pmod(k, F.lit(n)).cast("string") for n in (7, 25, 30)])
    return tables.table(s, d, "part").select(
        "p_partkey",
        version_compare(v, F.lit("3.12.15")).alias("three"),
        version_compare(v, F.lit("v3.12")).alias("short"),
        version_compare(F.concat(F.lit(" v"), v), F.lit("3.x.1")).alias("word"),
        version_compare(F.concat(v, F.lit("-rc"), F.col("p_size").cast("string")), F.concat(v, F.lit("-rc2"))).alias("suffix"),
    )


_A, _B, _C = "(p_partkey % 7)", "(p_partkey % 25)", "(p_partkey % 30)"
_VERSIONS = f"""SELECT p_partkey,
  CASE WHEN [{_A}, {_B}, {_C}] < [3, 12, 15] THEN -1 WHEN [{_A}, {_B}, {_C}] > [3, 12, 15] THEN 1 ELSE 0 END::INTEGER AS three,
  CASE WHEN [{_A}, {_B}] < [3, 12] THEN -1 ELSE 1 END::INTEGER AS short,
  CASE WHEN {_A} > 3 THEN 1 ELSE -1 END::INTEGER AS word,
  CASE WHEN 'rc' || p_size::VARCHAR < 'rc2' THEN -1 WHEN 'rc' || p_size::VARCHAR > 'rc2' THEN 1 ELSE 0 END::INTEGER AS suffix
FROM part"""


def _feed(s, d, mode):
    return advisories.vulnerable_deps_by_range(tables.locked_dependencies(s, d), tables.feed_advisories(s, d), mode).select(
        "file_id", "dep_no", "package", "version", "advisory_id")


def _feed_sql(mode: str) -> str:
    """The feed in numbers: every advisory is one or two intervals of versions."""
    package = "CASE WHEN {k} % 3 = 0 THEN 'left-pad' ELSE 'pkg' || ({k} % 1000) END"
    # Where all entries must hold, a single version and a bound above it never do.
    two = "(kind = 2 AND (n = lo OR n > 124990 + o_orderkey % 10))" if mode == "any" else "(kind = 2 AND n = lo AND n > 124990 + o_orderkey % 10)"
    last = f"kind = 3 AND (n BETWEEN lo AND hi {'OR' if mode == 'any' else 'AND'} n BETWEEN mid AND top)"
    return f"""WITH adv AS (SELECT o_orderkey, {package.format(k='o_orderkey')} AS package, (o_orderkey // 4) % 4 AS kind, (o_orderkey * 6947) % {tables.VERSIONS} AS lo,
        {", ".join(f"least((o_orderkey * 6947) % {tables.VERSIONS} + {more}, {tables.VERSIONS - 1}) AS {name}" for name, more in (("hi", "o_orderkey % 5"), ("mid", 2), ("top", 6)))} FROM orders),
      dep AS (SELECT l_orderkey, l_linenumber, {package.format(k='l_partkey')} AS package,
        (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % {tables.VERSIONS} AS n FROM lineitem)
      SELECT l_orderkey AS file_id, l_linenumber::INTEGER AS dep_no, package, (n // 2500) || '.' || (n // 50) % 50 || '.' || n % 50 AS version,
        'ADV-' || o_orderkey AS advisory_id FROM dep JOIN adv USING (package)
      WHERE (kind = 0 AND n BETWEEN lo AND hi) OR (kind = 1 AND n <= o_orderkey % 7) OR {two} OR ({last})"""


CHECKS = {
    "find_manifests": Check(
        lambda s, d: deps.find_manifests(tables.manifest_files(s, d)).select("file_id", "path", "language"),
        f"""SELECT p_partkey AS file_id, 'proj' || p_partkey::VARCHAR || '/' || CASE p_partkey % {_N} {' '.join(
            f"WHEN {i} THEN {lit(n)}" for i, (n, _) in enumerate(tables.MANIFESTS))} END AS path,
        CASE WHEN p_partkey % {_N} < 5 THEN 'python' WHEN p_partkey % {_N} < 9 THEN 'javascript' WHEN p_partkey % {_N} < 11 THEN 'php'
          WHEN p_partkey % {_N} < 14 THEN 'java' WHEN p_partkey % {_N} < 17 THEN 'dotnet' ELSE 'go' END AS language
        FROM part WHERE p_partkey % {_N} <> 21"""),
    "deps_requirements": _reader(["requirements.txt"], [0]),
    "deps_setup_py": _reader(["setup.py"], [1]),
    "deps_pyproject": _reader(["pyproject.toml"], [2]),
    "deps_pipfile": _reader(["Pipfile", "Pipfile.lock"], [3, 4]),
    "deps_package_json": _reader(["package.json"], [5]),
    "deps_package_lock": _reader(["package-lock.json"], [6, 7]),
    "deps_yarn_lock": _reader(["yarn.lock"], [8]),
    "deps_composer": _reader(["composer.json", "composer.lock"], [9, 10]),
    "deps_pom": _reader(["pom.xml"], [11]),
    "deps_gradle": _reader(["build.gradle"], [12, 13]),
    "deps_dotnet": _reader(["csproj", "packages.config", "project.json"], [14, 15, 16]),
    "deps_go": _reader(["go.mod", "go.sum", "Gopkg.toml", "Gopkg.lock"], [17, 18, 19, 20]),
    "deps_all": Check(lambda s, d: _all_deps(s, d).drop("dep_no"), _deps_sql()),
    "version_compare": Check(_versions, _VERSIONS),
    "vulnerable_deps": Check(
        lambda s, d: _hits(s, d).select("file_id", "path", "package", "version", "language", "advisory_id", "severity"),
        f"WITH {_HITS} SELECT file_id, path, package, version, language, advisory_id, severity FROM hits"),
    "vulnerable_deps_all_mode": Check(
        lambda s, d: _hits(s, d, "all").select("file_id", "package", "version"),
        f"""WITH {_HITS} SELECT file_id, package, version FROM (SELECT *, {_NUM} AS n FROM hits)
        WHERE (language = 'java' AND n >= [2, 0, 0] AND n <= [2, 14, 1]) OR (language = 'php' AND n < [4, 2, 12]) OR language NOT IN ('java', 'php')"""),
    "vulnerable_deps_by_range": Check(
        lambda s, d: advisories.vulnerable_deps_by_range(_all_deps(s, d), catalogues.advisory_table(s)).select(
            "file_id", "path", "package", "version", "language", "advisory_id", "severity"),
        f"WITH {_HITS} SELECT file_id, path, package, version, language, advisory_id, severity FROM hits"),
    "vulnerable_deps_feed": Check(lambda s, d: _feed(s, d, "any"), _feed_sql("any")),
    "vulnerable_deps_feed_all_mode": Check(lambda s, d: _feed(s, d, "all"), _feed_sql("all")),
    "vulnerable_deps_all_mode_languages": Check(
        lambda s, d: _hits(s, d, "all").select("file_id", "language", "package", "version"),
        f"""WITH {_HITS} SELECT file_id, language, package, version FROM (SELECT *, {_NUM} AS n FROM hits)
        WHERE (language = 'java' AND n >= [2, 0, 0] AND n <= [2, 14, 1]) OR (language = 'php' AND n < [4, 2, 12]) OR language NOT IN ('java', 'php')"""),
    "dedup_advisories": Check(
        lambda s, d: _unique(s, d).select("advisory_id", "package", "version", "path", "file_id"),
        f"WITH {_HITS}, {_FIRST} SELECT advisory_id, package, version, path, file_id FROM firsts"),
    "dependency_findings": Check(
        lambda s, d: deps.dependency_findings(_unique(s, d)).select(
            "file", "line", "phase", "type", "severity", "description", "mitigation", "dependency", "version", "advisory_id"),
        f"""WITH {_HITS}, {_FIRST} SELECT 'DEPENDENCY' AS file, 0::INTEGER AS line, 'dependency' AS phase, 'Vulnerable Dependency' AS type, severity,
        package || ' ' || version || ' has vulnerability: ' || title AS description, 'Update ' || package || ' to a version >= ' || patched AS mitigation,
        package AS dependency, version, advisory_id FROM firsts"""),
    "dependency_stats": Check(
        lambda s, d: deps.dependency_stats(_all_deps(s, d), _unique(s, d)),
        f"""WITH {_HITS}, {_FIRST} SELECT (SELECT count(*) FROM deps) AS total_dependencies, count(*) AS total_vulnerabilities,
        count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
        count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM firsts"""),
    "dependency_filter": Check(
        lambda s, d: select.dependency_filter(_mixed(s, d), "dependency").select("file", "phase", "dependency", "version"),
        f"WITH {_HITS}, {_FIRST} SELECT 'DEPENDENCY' AS file, 'dependency' AS phase, package AS dependency, version FROM firsts"),
}


def _mixed(s, d):
    """Dependency findings among pattern findings of the same manifests."""
    from codesift.operators import search

    return deps.dependency_findings(_unique(s, d)).unionByName(
        search.pattern_findings(tables.manifest_files(s, d), ["generic"]))

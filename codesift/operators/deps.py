"""Declared dependencies and the advisories that affect them.

Each manifest format is one expression from a text to an array of
dependencies, so all formats are read in a single pass over the files and no
step shuffles before the advisories are joined.
"""

from __future__ import annotations

import json
import sys
import tomllib

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codesift.catalog.advisories import MANIFEST_NAMES
from codesift.functions import text as tx
from codesift.functions.versions import is_affected
from codesift.operators.report import DEPENDENCY_FILE
from codesift.schemas import as_findings

# The TOML helper travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEP_TYPE = "array<struct<name:string,version:string,version_constraint:string,source:string>>"


def _dep(name: Column, version: Column, constraint: Column, source: Column) -> Column:
    return F.struct(
        name.alias("name"), version.alias("version"),
        constraint.alias("version_constraint"), source.alias("source"))


def _lines(text: Column) -> Column:
    return F.transform(tx.lines_of(text), tx.strip)


# --- find -------------------------------------------------------------------


def manifest_language(path: Column) -> Column:
    name, out = tx.base_name(path), None
    for language, names in MANIFEST_NAMES.items():
        exact = [n for n in names if not n.startswith("*")]
        test = name.isin(exact)
        for suffix in (n[1:] for n in names if n.startswith("*")):
            test = test | name.endswith(suffix)
        out = F.when(test, language) if out is None else out.when(test, language)
    return out


def find_manifests(files: DataFrame) -> DataFrame:
    return files.withColumn("language", manifest_language(F.col("path"))).where(F.col("language").isNotNull())


# --- one expression per format ------------------------------------------------

# Operators in the order they are looked for.
_REQUIREMENT_ORDER = ["==", ">=", "<=", ">", "<", "~="]
_PROJECT_ORDER = [">=", "<=", "==", ">", "<", "~="]


def _requirement(item: Column, order: list[str], source: Column, cut_marker: bool = False) -> Column:
    """Split ``name<op>version`` at the first operator of ``order`` it holds."""
    op = F.lit("")
    for o in reversed(order):
        op = F.when(F.contains(item, F.lit(o)), F.lit(o)).otherwise(op)

    def build(op: Column) -> Column:
        at = F.instr(item, op)
        name = F.when(op == "", item).otherwise(F.left(item, at - 1))
        version = F.when(op == "", "").otherwise(F.substr(item, at + F.length(op)))
        name = tx.strip(name)
        if cut_marker:
            name = tx.strip(F.substring_index(name, ";", 1))
        return _dep(name, tx.strip(version), op, source)

    return tx.let(op, build)


def requirements_txt(text: Column) -> Column:
    bare = F.transform(
        F.filter(_lines(text), lambda l: (l != "") & ~l.startswith("#")),
        lambda l: tx.strip(F.substring_index(l, "#", 1)))
    kept = F.filter(bare, lambda l: ~(l.startswith("git+") | l.startswith("http:") | l.startswith("https:")))
    return F.transform(
        kept, lambda l: _requirement(l, _REQUIREMENT_ORDER, F.lit("requirements.txt"), cut_marker=True))


def setup_py(text: Column) -> Column:
    section = F.regexp_extract(text, r"(?s)install_requires\s*=\s*\[(.*?)\]", 1)
    items = F.regexp_extract_all(section, F.lit(r"""['"]([^'"]+?)['"]"""), F.lit(1))
    return F.transform(items, lambda i: _requirement(i, _REQUIREMENT_ORDER, F.lit("setup.py")))


def _toml_as_json(doc: str) -> str | None:
    """A TOML document as JSON text; null when it does not parse."""
    try:
        return json.dumps(tomllib.loads(doc), default=str)
    except (tomllib.TOMLDecodeError, TypeError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def toml_as_json(text: pd.Series) -> pd.Series:
    return text.map(_toml_as_json, na_action="ignore")


def _json_map(doc: Column, path: str) -> Column:
    """Entries of a JSON object of texts (nested objects stay JSON text)."""
    schema = "map<string,string>"
    entries = F.map_entries(F.from_json(F.get_json_object(doc, path), F.lit(schema)))
    return F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))


def _plain_or_field(value: Column, field: str) -> tuple[Column, Column]:
    """A text value as it is; of an object its ``field``; and if one is known."""
    is_object = value.startswith("{") | value.startswith("[")
    inner = F.get_json_object(value, f"$.{field}")
    return F.when(is_object, F.coalesce(inner, F.lit(""))).otherwise(value), ~is_object | inner.isNotNull()


def pyproject(doc: Column) -> Column:
    """``doc`` is the document as JSON."""
    def poetry(e: Column) -> Column:
        version, known = _plain_or_field(e["value"], "version")
        return _dep(e["key"], version, F.when(known, "==").otherwise(""), F.lit("pyproject.toml (poetry)"))

    listed = F.coalesce(
        F.from_json(F.get_json_object(doc, "$.project.dependencies"), F.lit("array<string>")),
        F.array().cast("array<string>"))
    tables = F.filter(_json_map(doc, "$.tool.poetry.dependencies"), lambda e: e["key"] != "python")
    return F.concat(
        F.transform(tables, poetry),
        F.transform(listed, lambda d: _requirement(d, _PROJECT_ORDER, F.lit("pyproject.toml (PEP 621)"))))


def pipfile(doc: Column) -> Column:
    def section(name: str) -> Column:
        def one(e: Column) -> Column:
            plain = ~(e["value"].startswith("{") | e["value"].startswith("["))
            return _dep(e["key"], F.when(plain, e["value"]).otherwise(""),
                        F.when(plain, "==").otherwise(""), F.lit(f"Pipfile ({name})"))

        return F.transform(_json_map(doc, f"$.{name}"), one)

    return F.concat(section("packages"), section("dev-packages"))


def pipfile_lock(text: Column) -> Column:
    def section(name: str) -> Column:
        def one(e: Column) -> Column:
            version = F.coalesce(F.get_json_object(e["value"], "$.version"), F.lit(""))
            return _dep(e["key"], F.regexp_replace(version, "^==", ""), F.lit("=="), F.lit(f"Pipfile.lock ({name})"))

        return F.transform(_json_map(text, f"$.{name}"), one)

    return F.concat(section("default"), section("develop"))


def package_json(text: Column) -> Column:
    def section(name: str) -> Column:
        def one(e: Column) -> Column:
            first = F.left(e["value"], F.lit(1))
            # Symbols that count as a constraint.
            sign = F.when(first.isin("^", "~", ">", "<", "="), first).otherwise("==")
            return _dep(e["key"], e["value"], sign, F.lit(f"package.json ({name})"))

        return F.transform(_json_map(text, f"$.{name}"), one)

    return F.concat(section("dependencies"), section("devDependencies"))


def package_lock(text: Column, file_name: Column) -> Column:
    """Version 2 (``packages``) or version 1 (``dependencies``) lock files."""
    def of_path(e: Column) -> Column:
        last = F.substring_index(e["key"], "/", -1)
        parts = F.split(last, "@", -1)
        stated = F.coalesce(F.get_json_object(e["value"], "$.version"), F.lit(""))
        scoped = F.size(parts) > 1
        name = F.when(scoped, F.concat(F.lit("@"), F.get(parts, F.lit(1)))).otherwise(last)
        version = F.when(F.size(parts) > 2, F.get(parts, F.lit(2))).otherwise(stated)
        return _dep(name, version, F.lit("=="), file_name)

    def of_name(e: Column) -> Column:
        return _dep(e["key"], F.coalesce(F.get_json_object(e["value"], "$.version"), F.lit("")), F.lit("=="), file_name)

    packages = F.filter(_json_map(text, "$.packages"), lambda e: e["key"] != "")
    return F.when(F.get_json_object(text, "$.packages").isNotNull(), F.transform(packages, of_path)).otherwise(
        F.transform(_json_map(text, "$.dependencies"), of_name))


def yarn_lock(text: Column) -> Column:
    entry = r'([^\n"]+@[^\n"]+):\n\s+version\s+"([^"]+)"'
    specs = F.regexp_extract_all(text, F.lit(entry), F.lit(1))
    versions = F.regexp_extract_all(text, F.lit(entry), F.lit(2))
    return F.zip_with(specs, versions, lambda s, v: _dep(
        F.substring_index(s, "@", 1), v, F.lit("=="), F.lit("yarn.lock")))


def composer_json(text: Column) -> Column:
    def section(name: str, skip: list[str]) -> Column:
        entries = _json_map(text, f"$.{name}")
        if skip:
            entries = F.filter(entries, lambda e: ~e["key"].isin(skip))
        return F.transform(entries, lambda e: _dep(
            e["key"], e["value"], F.lit("=="), F.lit(f"composer.json ({name})")))

    return F.concat(section("require", ["php"]), section("require-dev", []))


def composer_lock(text: Column) -> Column:
    packages = F.from_json(
        F.get_json_object(text, "$.packages"), F.lit("array<struct<name:string,version:string>>"))
    return F.transform(packages, lambda p: _dep(
        F.coalesce(p["name"], F.lit("")), F.coalesce(p["version"], F.lit("")), F.lit("=="), F.lit("composer.lock")))


def pom_xml(text: Column) -> Column:
    section = F.regexp_extract(text, r"(?s)<dependencies>(.*?)</dependencies>", 1)
    blocks = F.regexp_extract_all(section, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))

    def one(b: Column) -> Column:
        def tag(name: str) -> Column:
            return F.regexp_extract(b, rf"(?d)<{name}>(.*?)</{name}>", 1)

        return F.when(
            (tag("groupId") != "") & (tag("artifactId") != ""),
            _dep(F.concat(tag("groupId"), F.lit(":"), tag("artifactId")), tag("version"), F.lit("=="), F.lit("pom.xml")))

    return F.array_compact(F.transform(blocks, one))


def gradle(text: Column, file_name: Column) -> Column:
    section = F.regexp_extract(text, r"(?s)dependencies\s*\{(.*?)\}", 1)
    # Fixed value: the seven configurations and the coordinate form.
    entry = (r"""(?:implementation|api|compile|runtime|testImplementation|testRuntime|testCompile)"""
             r"""\s*[\('"]([^:'"]+):([^:'"]+):([^'"]+)[\)'"]""")
    return F.transform(F.regexp_extract_all(section, F.lit(entry), F.lit(0)), lambda m: _dep(
        F.concat(F.regexp_extract(m, entry, 1), F.lit(":"), F.regexp_extract(m, entry, 2)),
        F.regexp_extract(m, entry, 3), F.lit("=="), file_name))


def _tags(text: Column, pattern: str, source: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _dep(
        F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2), F.lit("=="), source))


def csproj(text: Column, file_name: Column) -> Column:
    return _tags(text, r'<PackageReference\s+Include="([^"]+)"\s+Version="([^"]+)"', file_name)


def packages_config(text: Column) -> Column:
    return _tags(text, r'<package\s+id="([^"]+)"\s+version="([^"]+)"', F.lit("packages.config"))


def project_json(text: Column) -> Column:
    return F.transform(_json_map(text, "$.dependencies"), lambda e: _dep(
        e["key"], _plain_or_field(e["value"], "version")[0], F.lit("=="), F.lit("project.json")))


def go_mod(text: Column) -> Column:
    """Single ``require`` lines and the entries of ``require ( ... )`` blocks."""
    single = r"^require\s+([^ ]+)\s+(.+)"
    block = r"(?dms)^[ \t]*require \([ \t\r]*$(.*?)(?:^[ \t]*\)[ \t\r]*$|\z)"
    source = F.lit("go.mod")

    def unv(v: Column) -> Column:
        return F.trim(tx.strip(v), F.lit("v"))

    singles = F.transform(F.filter(_lines(text), lambda l: l.rlike(single)), lambda l: _dep(
        F.regexp_extract(l, single, 1), unv(F.regexp_extract(l, single, 2)), F.lit("=="), source))
    entries = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(block), F.lit(1)), _lines))
    rows = F.filter(entries, lambda l: ~l.rlike(single) & l.rlike(r"\S\s+\S"))
    return F.concat(singles, F.transform(rows, lambda l: tx.let(
        F.split(l, r"\s+", -1),
        lambda p: _dep(F.get(p, F.lit(0)), unv(F.get(p, F.lit(1))), F.lit("=="), source))))


_GO_NAME = r'(?dm)^\s*name\s*=\s*"([^"]+)"'
_GO_VERSION = r'(?dm)^\s*version\s*=\s*"([^"]+)"'


def gopkg_toml(text: Column) -> Column:
    """Every named constraint, with the first version stated in the file."""
    names = F.regexp_extract_all(text, F.lit(_GO_NAME), F.lit(1))
    version = F.regexp_extract(text, _GO_VERSION, 1)
    return F.transform(names, lambda n: _dep(n, version, F.lit("=="), F.lit("Gopkg.toml")))


def gopkg_lock(text: Column) -> Column:
    """Name and version of each project that states both."""
    parts = F.split(text, r"(?dm)^[ \t]*\[\[projects\]\][ \t\r]*$", -1)
    sections = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_compact(F.transform(sections, lambda s: F.when(
        s.rlike(_GO_NAME) & s.rlike(_GO_VERSION),
        _dep(F.regexp_extract(s, _GO_NAME, 1), F.regexp_extract(s, _GO_VERSION, 1), F.lit("=="), F.lit("Gopkg.lock")))))


def go_sum(text: Column) -> Column:
    parts = F.transform(F.filter(_lines(text), lambda l: l.rlike(r"\S\s+\S")), lambda l: F.split(l, r"\s+", -1))
    kept = F.filter(parts, lambda p: ~F.get(p, F.lit(0)).rlike(r"/v[0-9]+\.[0-9]+\.[0-9]+[^/]*$")
                    & ~F.get(p, F.lit(1)).startswith("h1:"))
    return F.transform(kept, lambda p: _dep(
        F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.lit("=="), F.lit("go.sum")))


# --- readers ------------------------------------------------------------------

_TOML_NAMES = ("pyproject.toml", "Pipfile")


# File test and expression (of text, TOML document and file name) per format.
FORMATS = {
    "requirements.txt": (["requirements.txt"], lambda text, doc, name: requirements_txt(text)),
    "setup.py": (["setup.py"], lambda text, doc, name: setup_py(text)),
    "pyproject.toml": (["pyproject.toml"], lambda text, doc, name: pyproject(doc)),
    "Pipfile": (["Pipfile"], lambda text, doc, name: pipfile(doc)),
    "Pipfile.lock": (["Pipfile.lock"], lambda text, doc, name: pipfile_lock(text)),
    "package.json": (["package.json"], lambda text, doc, name: package_json(text)),
    "package-lock.json": (["package-lock.json", "npm-shrinkwrap.json"], lambda text, doc, name: package_lock(text, name)),
    "yarn.lock": (["yarn.lock"], lambda text, doc, name: yarn_lock(text)),
    "composer.json": (["composer.json"], lambda text, doc, name: composer_json(text)),
    "composer.lock": (["composer.lock"], lambda text, doc, name: composer_lock(text)),
    "pom.xml": (["pom.xml"], lambda text, doc, name: pom_xml(text)),
    "build.gradle": (["build.gradle", "build.gradle.kts"], lambda text, doc, name: gradle(text, name)),
    "csproj": (["*.csproj"], lambda text, doc, name: csproj(text, name)),
    "packages.config": (["packages.config"], lambda text, doc, name: packages_config(text)),
    "project.json": (["project.json"], lambda text, doc, name: project_json(text)),
    "go.mod": (["go.mod"], lambda text, doc, name: go_mod(text)),
    "Gopkg.toml": (["Gopkg.toml"], lambda text, doc, name: gopkg_toml(text)),
    "Gopkg.lock": (["Gopkg.lock"], lambda text, doc, name: gopkg_lock(text)),
    "go.sum": (["go.sum"], lambda text, doc, name: go_sum(text)),
}
_TOML_FORMATS = ("pyproject.toml", "Pipfile")


def _named(name: Column, names: list[str]) -> Column:
    return name.endswith(names[0][1:]) if names[0].startswith("*") else name.isin(names)


def read_dependencies(files: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Dependencies of the named formats (all by default) in one pass.

    Only the text of TOML documents is sent to Python, and only when a TOML
    format is asked for.
    """
    wanted = formats or list(FORMATS)
    name, text = F.col("_name"), F.col("text")
    rows = find_manifests(files).select("file_id", "path", "language", "text", tx.base_name(F.col("path")).alias("_name"))
    rows = rows.withColumn("_format", F.coalesce(*[F.when(_named(name, FORMATS[f][0]), f) for f in wanted]))
    rows = rows.where(F.col("_format").isNotNull())
    toml = [f for f in wanted if f in _TOML_FORMATS]
    doc = toml_as_json(F.when(F.col("_format").isin(toml), text)) if toml else F.lit(None).cast("string")
    rows = rows.withColumn("_doc", doc)
    value = F.lit(None).cast(DEP_TYPE)
    for f in wanted:
        value = F.when(F.col("_format") == f, FORMATS[f][1](text, F.col("_doc"), name).cast(DEP_TYPE)).otherwise(value)
    found = rows.select("file_id", "path", "language", F.posexplode_outer(value).alias("dep_no", "d"))
    return found.where(F.col("d").isNotNull()).select(
        "file_id", "path", "dep_no", "d.name", "d.version", "d.version_constraint", "language", "d.source")


# --- advisories -----------------------------------------------------------------


def vulnerable_deps(deps: DataFrame, advisories: DataFrame, mode: str = "any") -> DataFrame:
    """Dependencies joined to the advisories that affect their version.

    The advisory side is small by nature; whether it is broadcast is left to
    the optimizer, which knows its size.
    """
    a = advisories.select(
        F.col("id").alias("advisory_id"), "language", F.col("package").alias("name"), "affected_versions",
        "patched_versions", "severity", "title", "description", "references", "published_date")
    return deps.join(a, ["language", "name"]).where(
        is_affected(F.col("version"), F.col("affected_versions"), mode)).withColumnRenamed("name", "package")


def dedup_advisories(hits: DataFrame) -> DataFrame:
    """The first row per (advisory, package, version), by path and position;
    aggregated map-side."""
    keys = ["advisory_id", "package", "version"]
    rest = [c for c in hits.columns if c not in keys and c not in ("path", "file_id", "dep_no")]
    first = hits.groupBy(*keys).agg(F.min(F.struct("path", "file_id", "dep_no", *rest)).alias("f"))
    return first.select(*keys, "f.*")


def dependency_findings(hits: DataFrame) -> DataFrame:
    patched = F.coalesce(F.get("patched_versions", F.lit(0)), F.lit("?"))
    return as_findings(
        hits, "dependency",
        file=F.lit(DEPENDENCY_FILE), line=F.lit(0), col=F.lit(0), match_no=F.col("dep_no"),
        rule_id=F.col("advisory_id"), type=F.lit("Vulnerable Dependency"),
        dependency=F.col("package"),
        description=F.concat(F.col("package"), F.lit(" "), F.col("version"), F.lit(" has vulnerability: "), F.col("title")),
        mitigation=F.concat(F.lit("Update "), F.col("package"), F.lit(" to a version >= "), patched))


def dependency_stats(deps: DataFrame, unique_hits: DataFrame) -> DataFrame:
    """Totals in one aggregation over both tables."""
    none = F.lit(None).cast("string")
    rows = deps.select(F.lit(1).alias("dep"), none.alias("severity")).unionByName(
        unique_hits.select(F.lit(0).alias("dep"), "severity"))
    s = F.col("severity")
    return rows.agg(
        F.count_if(F.col("dep") == 1).alias("total_dependencies"),
        F.count_if(F.col("dep") == 0).alias("total_vulnerabilities"),
        F.count_if(s == "Critical").alias("critical"),
        F.count_if(s == "High").alias("high"),
        F.count_if(s == "Medium").alias("medium"),
        F.count_if(s == "Low").alias("low"),
    )

"""Rule, query and advisory catalogues as tables and as match rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codesift.catalog.advisories import ADVISORY_ROWS, reference_link
from codesift.catalog.languages import RULE_LANGUAGE_EXTENSIONS
from codesift.catalog.patterns import PATTERN_ROWS
from codesift.catalog.queries import DANGEROUS_EVAL_PATTERN, SAVED_QUERY_ROWS
from codesift.catalog.secrets import SECRET_ROWS
from codesift.catalog.structural import APPLIED_PATTERN_TYPES, STRUCTURAL_RULE_ROWS
from codesift.functions import text as tx
from codesift.operators.match import Rule
from codesift.session import local_table

PATTERN_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("with_string_formatting", T.BooleanType()),
    T.StructField("include_methods", T.BooleanType()),
    T.StructField("variable_name", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("with", T.StringType()),
])
RULE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("patterns", T.ArrayType(PATTERN_SCHEMA)),
    T.StructField("mitigation", T.StringType()),
])
RULE_FILE_SCHEMA = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("rules", T.ArrayType(RULE_SCHEMA)),
])
QUERY_SCHEMA = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("id", "name", "description", "language", "type", "pattern", "severity")
] + [T.StructField("tags", T.ArrayType(T.StringType()))])


def _hints(text: str) -> tuple[str, ...]:
    return tuple(h for h in text.split("|") if h)


def pattern_rules(groups: list[str] | None = None) -> list[Rule]:
    """The 73 pattern rules; ids number the rules inside their group."""
    seen: dict[str, int] = {}
    out = []
    for group, kind, pattern, description, severity, confidence, cwe, hints in PATTERN_ROWS:
        seen[group] = seen.get(group, 0) + 1
        if groups is None or group in groups:
            out.append(Rule(f"{group}-{seen[group]}", pattern, group, _hints(hints), {
                "type": kind, "description": description, "severity": severity,
                "confidence": confidence, "cwe": cwe,
            }))
    return out


# How eight of the secret patterns begin: any run of name characters.
_ANY_PREFIX = "(?i)([a-z0-9_-]+)?"
# All that such a pattern takes before its sign is one run of name characters,
# so a match begins where a run begins, and only in a run that a sign follows.
# Tested first, this keeps a long run without a sign linear.
_RUN_START = r"(?i)(?<![a-z0-9_-])(?=[a-z0-9_-]++\s*+[=:])"


def linear(pattern: str) -> str | None:
    """A form of the pattern with the same matches that reads a run once."""
    if not pattern.startswith(_ANY_PREFIX):
        return None
    return _RUN_START + pattern.removeprefix("(?i)")


def secret_rules() -> list[Rule]:
    return [
        Rule(f"secret-{i}", pattern, None, _hints(hints), {"category": category}, linear(pattern))
        for i, (category, pattern, hints) in enumerate(SECRET_ROWS, 1)
    ]


def saved_query_rules(query_id: str | None = None) -> list[Rule]:
    """The saved regex queries; of Python or common to all, they run on Python files."""
    return [
        Rule(qid, pattern, ".py", (), {"name": name, "severity": severity, "language": language})
        for qid, name, _desc, language, kind, pattern, severity, _tags in SAVED_QUERY_ROWS
        if kind == "regex" and query_id in (None, qid)
    ]


def pattern_table(spark: SparkSession) -> DataFrame:
    rows = [(r.group, r.rule_id, r.labels["type"], r.pattern, r.labels["description"],
             r.labels["severity"], r.labels["confidence"], r.labels["cwe"]) for r in pattern_rules()]
    return local_table(
        spark, rows, "lang string, rule_id string, type string, pattern string, description string, "
              "severity string, confidence string, cwe string")


def _is_applied():
    """Whether an operator reads the pattern: facts are those of Python files,
    and an assignment is known by the name of its variable."""
    kind = F.col("p.type")
    named = F.when(kind == "assignment", F.col("p.variable_name").isNotNull()).otherwise(F.lit(True))
    return F.coalesce(kind.isin(APPLIED_PATTERN_TYPES) & named, F.lit(False)) & (extension_of_language(F.col("language")) == ".py")


def _one_row_per_pattern(rule_files: DataFrame) -> DataFrame:
    rules = rule_files.select(
        F.coalesce("language", F.lit("common")).alias("language"), F.explode("rules").alias("r"))
    rows = rules.select("language", "r.*").select("*", F.posexplode("patterns").alias("pattern_no", "p"))
    return rows.select(
        "language",
        F.coalesce("id", F.lit("UNKNOWN")).alias("rule_id"),
        F.coalesce("name", F.lit("Unknown Rule")).alias("rule_name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("severity", F.lit("Medium")).alias("severity"),
        F.coalesce("mitigation", F.lit("")).alias("mitigation"),
        "pattern_no",
        F.col("p.type").alias("pattern_type"),
        F.col("p.name").alias("name"),
        F.coalesce("p.with_string_formatting", F.lit(False)).alias("with_string_formatting"),
        F.coalesce("p.include_methods", F.lit(True)).alias("include_methods"),
        F.col("p.variable_name").alias("variable_name"),
        F.col("p.target").alias("target"),
        F.col("p.pattern").alias("pattern"),
        F.col("p.with").alias("with"),
        _is_applied().alias("applied"),
    )


def rules_table(spark: SparkSession) -> DataFrame:
    """Built-in structural rules, one row per pattern."""
    by_language: dict[str, list[dict]] = {}
    for language, rid, name, description, severity, patterns, mitigation in STRUCTURAL_RULE_ROWS:
        by_language.setdefault(language, []).append({
            "id": rid, "name": name, "description": description, "severity": severity,
            "patterns": patterns, "mitigation": mitigation})
    rows = [{"language": k, "rules": v} for k, v in by_language.items()]
    return _one_row_per_pattern(local_table(spark, rows, RULE_FILE_SCHEMA))


def read_rules_json(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema(RULE_FILE_SCHEMA).json(path, multiLine=True)
    return _one_row_per_pattern(files)


def read_rules_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Rule files in YAML, read whole by Spark, so from any storage it knows;
    a small configuration that the driver parses.

    A file may hold several ``language``/``rules`` blocks one after the other;
    each block keeps its own language.
    """
    import yaml

    rows = []
    sources = (
        spark.read.option("pathGlobFilter", "*.{yaml,yml}").text(path, wholetext=True)
        .select(F.input_file_name().alias("name"), "value").orderBy("name").collect())
    for source in (row["value"] for row in sources):
        blocks, current = [], []
        for line in source.splitlines():
            if line.startswith("language:") and current:
                blocks.append(current)
                current = []
            current.append(line)
        blocks.append(current)
        for block in blocks:
            data = yaml.safe_load("\n".join(block)) or {}
            if data.get("rules"):
                rows.append(json.dumps({"language": data.get("language"), "rules": data["rules"]}))
    parsed = local_table(spark, [(r,) for r in rows], "doc string").select(
        F.from_json("doc", RULE_FILE_SCHEMA).alias("d"))
    return _one_row_per_pattern(parsed.select("d.*"))


def query_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, SAVED_QUERY_ROWS, QUERY_SCHEMA)


def read_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Saved queries below ``path`` and the rows skipped for a missing field."""
    raw = (
        spark.read.schema(QUERY_SCHEMA).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json").json(path, multiLine=True)
        .withColumn("id", F.coalesce("id", F.regexp_replace(
            F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json", "")))
    )
    whole = F.col("language").isNotNull() & F.col("name").isNotNull() & F.col("pattern").isNotNull()
    loaded = raw.where(whole).withColumns({
        "type": F.coalesce("type", F.lit("regex")),
        "severity": F.coalesce("severity", F.when(F.col("type") == "ast", "High").otherwise("Medium")),
    })
    return loaded, raw.where(~whole)


def query_extension(language):
    """Extension a query of a language runs on; null for other languages."""
    known = {"common": ".py", **RULE_LANGUAGE_EXTENSIONS}
    return F.try_element_at(tx.text_map(known), F.lower(language))


def _structural_query():
    return (F.col("type") == "ast") & F.contains("pattern", F.lit("dangerous_eval"))


def query_rules(queries: DataFrame) -> DataFrame:
    """A query table as rules for ``find_matches``.  Of the structural queries
    only ``dangerous_eval`` has a meaning: it is a search for a fixed text.  A
    query runs on the files of its language; see ``skipped_queries``."""
    structural = _structural_query()
    return queries.where((F.coalesce("type", F.lit("regex")) == "regex") | structural).select(
        F.col("id").alias("rule_id"),
        F.when(structural, DANGEROUS_EVAL_PATTERN).otherwise(F.col("pattern")).alias("pattern"),
        query_extension(F.col("language")).alias("group"), "name", "severity", "language",
    ).where(F.col("group").isNotNull())


def skipped_queries(queries: DataFrame) -> DataFrame:
    """Queries that do not run, with the reason."""
    regex = F.coalesce("type", F.lit("regex")) == "regex"
    reason = F.when(query_extension(F.col("language")).isNull(), "language").when(~(regex | _structural_query()), "type")
    return queries.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("id", "language", "type", "reason")


def advisory_table(spark: SparkSession) -> DataFrame:
    rows = [(i, lang, pkg, aff, pat, sev, title, desc, [reference_link(i)], day)
            for i, lang, pkg, aff, pat, sev, title, desc, day in ADVISORY_ROWS]
    return local_table(
        spark, rows, "id string, language string, package string, affected_versions array<string>, "
              "patched_versions array<string>, severity string, title string, description string, "
              "references array<string>, published_date string",
    ).withColumn("published_date", F.to_date("published_date"))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(advisory_table(spark).schema).json(path, multiLine=True)


def extension_of_language(language):
    """Rule language to file extension; ``common`` rules apply to Python."""
    return F.coalesce(F.try_element_at(tx.text_map(RULE_LANGUAGE_EXTENSIONS), language), F.lit(".py"))

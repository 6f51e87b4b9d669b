"""Secrets and personal data in files, and keys in ``.env`` files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codesift.catalog import secrets as cat
from codesift.catalog.languages import MAX_FILE_BYTES
from codesift.functions import text as tx
from codesift.operators.match import find_matches
from codesift.sources.catalogues import secret_rules

# Findings of one rule in one file that share a chunk in findings_by_file.
CHUNK = 1000


def _alternation(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def is_sensitive_file(path: Column) -> Column:
    return path.rlike(tx.java_regex(_alternation(cat.SENSITIVE_FILE_PATTERNS), "idU"))


def is_false_positive(line: Column) -> Column:
    return line.rlike(tx.java_regex(_alternation(cat.FALSE_POSITIVE_PATTERNS)))


def secret_severity(category: Column, sensitive_file: Column) -> Column:
    return (
        F.when(category.isin(cat.HIGH_CATEGORIES), "High")
        .when(category.isin(cat.MEDIUM_CATEGORIES), "Medium")
        .when(sensitive_file, "High")
        .otherwise("Low")
    )


def scan_sensitive(files: DataFrame, context: bool = True) -> DataFrame:
    """One row per match of the 23 patterns, with flags and severity."""
    rows = find_matches(
        files, secret_rules(), code=False, context=context,
        line_flags={"probable_false_positive": is_false_positive})
    sensitive = is_sensitive_file(F.col("path"))
    return rows.withColumns({
        "is_sensitive_file": sensitive,
        "severity": secret_severity(F.col("category"), sensitive),
    }).withColumnRenamed("path", "file")


def drop_false_positives(secrets: DataFrame) -> DataFrame:
    return secrets.where(~F.col("probable_false_positive"))


def as_secret_rows(findings: DataFrame) -> DataFrame:
    """Pattern secrets in the secrets shape; the value itself is masked."""
    return findings.select(
        "file_id", "file", "line", F.col("category").alias("key"), "match", "context",
        F.lit("*****").alias("value_preview"),
        F.col("severity").alias("confidence"),
        "is_sensitive_file",
    )


def env_confidence(key: Column) -> Column:
    return tx.let(F.lower(key), lambda low: (
        F.when(tx.contains_any(low, cat.ENV_HIGH_WORDS), "High")
        .when(tx.contains_any(low, cat.ENV_MEDIUM_WORDS), "Medium")
        .otherwise("Low")
    ))


def env_pairs(files: DataFrame) -> DataFrame:
    """``key=value`` lines of ``.env`` files, split at the first ``=``."""
    lines = (
        files.where(F.col("path").endswith(".env"))
        .select("file_id", F.col("path").alias("file"), F.posexplode(tx.lines_of(F.col("text"))).alias("i", "raw"))
        .select("file_id", "file", (F.col("i") + 1).cast("int").alias("line"), tx.strip(F.col("raw")).alias("raw"))
        .where((F.col("raw") != "") & ~F.col("raw").startswith("#") & F.contains("raw", F.lit("=")))
    )
    key = F.substring_index("raw", "=", 1)
    return lines.select(
        "file_id", "file", "line",
        tx.strip(key).alias("key"),
        tx.strip(F.substr("raw", F.length(key) + 2)).alias("value"),
    ).where(F.col("value") != "")


def env_secrets(files: DataFrame) -> DataFrame:
    """Keys that look like secrets, with a masked value and a confidence."""
    secret_key = F.col("key").rlike(tx.java_regex(_alternation(cat.ENV_KEY_PATTERNS), "idU"))
    return env_pairs(files).where(secret_key).select(
        "file_id", "file", "line", "key",
        tx.mask_value(F.col("value")).alias("value_preview"),
        env_confidence(F.col("key")).alias("confidence"),
    )


def secrets_union(env: DataFrame, pattern_secrets: DataFrame) -> DataFrame:
    return pattern_secrets.unionByName(env, allowMissingColumns=True)


def all_secrets(files: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """Both kinds over one corpus, likely false positives left out.  Files over
    ``max_bytes`` (none with ``None``) are searched for keys only."""
    capped = files if max_bytes is None else files.where(F.col("size") <= max_bytes)
    return secrets_union(env_secrets(files), as_secret_rows(drop_false_positives(scan_sensitive(capped))))


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Findings grouped by file, in arrays of bounded size.

    A file with very many findings is split into chunks by match number, so no
    group grows with the data: at most CHUNK rows per rule and chunk.
    """
    item = F.struct("line", "rule_id", "match_no", "category", "severity", "match")
    return (
        findings.groupBy("file_id", "file", F.floor(F.col("match_no") / CHUNK).cast("int").alias("chunk"))
        .agg(F.sort_array(F.collect_list(item)).alias("findings"))
        .withColumn("n", F.size("findings"))
    )


def secret_severity_breakdown(findings: DataFrame) -> DataFrame:
    s = F.col("severity")
    return findings.agg(
        F.count_if(s == "High").alias("high"),
        F.count_if(s == "Medium").alias("medium"),
        F.count_if(s == "Low").alias("low"),
        F.count("*").alias("total"),
    )


def high_entropy_tokens(
    files: DataFrame, threshold: float = cat.ENTROPY_THRESHOLD, token: str = r"[A-Za-z0-9+/=_-]{20,}"
) -> DataFrame:
    rows = files.select(
        "file_id", F.explode_outer(F.regexp_extract_all("text", F.lit(tx.java_regex(token)), F.lit(0))).alias("token")
    ).where(F.col("token").isNotNull())
    return rows.withColumn("entropy", tx.shannon_entropy(F.col("token"))).where(F.col("entropy") > threshold)


def detect_code_language(text: Column) -> Column:
    def has(*words: str) -> Column:
        return tx.contains_any(text, list(words))

    # Markers of each language, tested in this order.
    return (
        F.when(has("def ") & has("self", "import "), "python")
        .when(has("{") & has("function ", "var ", "const ", "let "), "javascript")
        .when(has("<?php") | (has("$") & has("function ")), "php")
        .when(has("public class ", "private class ", "public static void "), "java")
        .when(has("#include") & has("int main", "void main"), "c")
        .when(has("<") & has(">") & has("</", "/>"), "html")
        .otherwise("unknown")
    )

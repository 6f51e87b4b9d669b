"""Whole scans: the pattern scan and the scan with all phases.

Both return lazy DataFrames; the caller writes or rolls up what it wants.  The
files are read once per phase that needs their text; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from codesift.catalog.languages import MAX_FILE_BYTES
from codesift.operators import account, deps, facts as fx, flow, report, score, search, secrets, select, taint
from codesift.sources import catalogues, corpus


@dataclass(frozen=True)
class Scan:
    files: DataFrame
    findings: DataFrame
    secrets: DataFrame | None = None
    extra: DataFrame | None = None
    skipped: DataFrame | None = None

    def totals(self) -> DataFrame:
        secrets_ = self.secrets if self.secrets is not None else self.files.sparkSession.createDataFrame([], "file string")
        return report.scan_totals(self.files, self.findings, secrets_)


def pattern_scan(
    files: DataFrame,
    extensions: list[str] | None = None,
    exclude_pattern: str | None = None,
    with_secrets: bool = True,
    search_pattern: str | None = None,
    search_functions: list[str] | None = None,
    max_bytes: int | None = MAX_FILE_BYTES,
) -> Scan:
    """Rules by extension, calls of Python files, scores, and secrets.

    Files over ``max_bytes`` (none with ``None``) are left out and listed in
    ``skipped``, with what could not be parsed.
    """
    chosen = select.env_files(files, extensions) if with_secrets else select.supported_files(files, extensions)
    if exclude_pattern:
        chosen = select.exclude_paths(chosen, exclude_pattern)
    texts = corpus.size_cap(chosen.where(~F.col("path").endswith(".env")) if with_secrets else chosen, max_bytes)
    facts = fx.fact_table(texts)
    findings = score.score_findings(report.all_findings(
        search.pattern_findings(texts), fx.dangerous_calls(facts), fx.user_input_calls(facts), fx.syntax_errors(facts)))
    extra = None
    if search_pattern:
        extra = search.search_pattern(texts, search_pattern)
    if search_functions:
        named = search.search_functions(texts, search_functions)
        extra = named if extra is None else extra.unionByName(named, allowMissingColumns=True)
    found = secrets.all_secrets(chosen, max_bytes) if with_secrets else None
    return Scan(chosen, findings, found, extra, account.skipped_files(chosen, facts, max_bytes))


def advanced_scan(
    files: DataFrame,
    extensions: list[str] | None = None,
    rules: DataFrame | None = None,
    queries: DataFrame | None = None,
    advisories: DataFrame | None = None,
    match: str = "identifier",
    max_bytes: int | None = MAX_FILE_BYTES,
) -> Scan:
    """Structural rules, data flow, control flow, dependencies and queries.

    The parsed facts are written once to the shared folder and read by the
    three phases that join on them.  The size cap holds for parsed files only:
    manifests and queries see every file given.
    """
    spark = files.sparkSession
    supported = select.supported_files(files, extensions)
    chosen = corpus.size_cap(supported, max_bytes)
    names = None if rules is None else fx.rule_names(rules)
    rules = catalogues.rules_table(spark) if rules is None else rules
    advisories = catalogues.advisory_table(spark) if advisories is None else advisories
    facts = fx.fact_table(chosen, names)
    tainted = taint.taint_propagate(facts, match=match)
    hits = deps.dedup_advisories(deps.vulnerable_deps(deps.read_dependencies(files), advisories))
    findings = report.all_findings(
        fx.rule_calls(facts, rules), fx.rule_imports(facts, rules), fx.rule_assignments(facts, rules),
        fx.rule_exceptions(facts, rules),
        taint.taint_findings(taint.taint_to_sinks(facts, tainted, match=match)),
        flow.bare_except(facts), flow.unmanaged_open(facts),
        deps.dependency_findings(hits), search.run_all_queries(files, queries))
    return Scan(chosen, findings, skipped=account.skipped_files(files, facts, max_bytes))


def findings_per_severity(files: DataFrame) -> DataFrame:
    """Scored findings of a prose corpus per severity and type."""
    rows = score.score_findings(search.pattern_findings(files, ["generic", "sensitive_data"]))
    return rows.groupBy("severity", "type").agg(
        F.count("*").alias("findings"), F.countDistinct("file_id").alias("files"))

"""Regex rules over a corpus of texts.

A catalogue is a list of :class:`Rule`, or a small table of them, compiled into
literal patterns.  No step shuffles or joins: the text is read once, tested
against every rule in place, and only the (file, rule) pairs that match are
expanded to one row per match.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codesift.functions import text as tx

GENERIC = "generic"


@dataclass(frozen=True)
class Rule:
    """One regex with the group of files it applies to and its labels."""

    rule_id: str
    pattern: str
    group: str | None = None
    hints: tuple[str, ...] = ()
    labels: dict[str, str | None] = field(default_factory=dict)
    # A pattern with the same matches that is run in place of ``pattern``.
    run: str | None = None

    @property
    def regex(self) -> str:
        return self.run or self.pattern


def _label_names(rules: Sequence[Rule]) -> list[str]:
    return sorted({name for rule in rules for name in rule.labels})


def _rule_sql(rule: Rule, names: list[str], flags: str) -> str:
    fields = {"rule_id": rule.rule_id, "pattern": tx.java_regex(rule.regex, flags)}
    fields |= {n: rule.labels.get(n) for n in names}
    return "named_struct(" + ", ".join(f"'{n}', {tx.sql_text(v)}" for n, v in fields.items()) + ")"


def _applies_sql(rule: Rule, grouped: bool, flags: str) -> str:
    """Cheap tests first: group, then literals, then the regex itself."""
    tests = []
    if rule.group is not None and grouped:
        tests.append(f"_group = {tx.sql_text(rule.group)}")
    if rule.hints:
        hinted = [
            f"text RLIKE {tx.sql_text(h[1:])}" if h.startswith("~") else f"contains(_folded, {tx.sql_text(h.upper())})"
            for h in rule.hints]
        if "(?i)" in rule.pattern:
            hinted.append("_odd_case")
        tests.append("(" + " OR ".join(hinted) + ")")
    tests.append(f"text RLIKE {tx.sql_text(tx.java_regex(rule.regex, flags))}")
    return " AND ".join(tests)


def _pairs(files: DataFrame, rules: list[Rule], group: Column | None, keep: list[str], flags: str) -> DataFrame:
    """(file, rule) pairs that match: one row per pair, the text still whole."""
    names = _label_names(rules)
    rows = files.select(
        *keep, "text",
        *([group.alias("_group")] if group is not None else []),
        *([F.upper("text").alias("_folded"), tx.has_odd_case(F.col("text")).alias("_odd_case")]
          if any(r.hints for r in rules) else []))
    cases = [f"CASE WHEN {_applies_sql(r, group is not None, flags)} THEN {i} END" for i, r in enumerate(rules)]
    hits = F.expr("array_compact(array(" + ", ".join(cases) + "))")
    catalogue = F.expr("array(" + ", ".join(_rule_sql(r, names, flags) for r in rules) + ")")
    # explode_outer + filter: a plain explode lets the optimizer infer
    # size(hits) > 0 below the projection and run every regex twice.
    return (
        rows.select(*keep, "text", hits.alias("_hits"))
        .select(*keep, "text", F.explode_outer("_hits").alias("_hit"))
        .where(F.col("_hit").isNotNull())
        .select(*keep, "text", F.get(catalogue, F.col("_hit")).alias("rule"))
    )


# Regexes are literals of the plan, so a larger catalogue is run part by part
# and the matches are united.
MAX_RULES = 2000

# A regex without matches, for an empty catalogue.
NEVER = "(?!)"


def rules_from_table(rules: DataFrame) -> list[Rule]:
    """Rules of a table: ``rule_id``, ``pattern``, optionally ``group`` and any
    text columns as labels.  A catalogue is configuration the driver reads."""
    labels = [c for c in rules.columns if c not in ("rule_id", "pattern", "group")]
    rows = rules.collect()
    if not rows:
        return [Rule("none", NEVER, None, (), dict.fromkeys(labels))]
    return [
        Rule(r["rule_id"], r["pattern"], r["group"] if "group" in rules.columns else None, (),
             {c: r[c] for c in labels})
        for r in rows]


def find_matches(
    files: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    group: Column | None = None,
    keep: Sequence[str] = ("file_id", "path"),
    flags: str = tx.REGEX_FLAGS,
    code: bool = True,
    context: bool = False,
    context_rows: bool = False,
    end_line: bool = False,
    line_flags: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Every non-overlapping match of every applicable rule, one row each.

    Columns: ``keep``, ``rule_id``, the rule labels, ``match_no`` (0-based
    within file and rule), ``line``, ``match`` and, on request, ``line_end``,
    ``code`` (the trimmed line), ``context`` (two lines around, as text),
    ``context_rows`` (the same as an array) and ``line_flags`` (tests of the
    line, made once per line).
    """
    keep = list(keep)
    rules = rules_from_table(rules) if isinstance(rules, DataFrame) else list(rules) or [Rule("none", NEVER)]
    if len(rules) > MAX_RULES:
        names = _label_names(rules)
        rules = [replace(r, labels={**dict.fromkeys(names), **r.labels}) for r in rules]
        parts = [
            find_matches(files, rules[i:i + MAX_RULES], group, keep, flags, code, context, context_rows, end_line, line_flags)
            for i in range(0, len(rules), MAX_RULES)]
        return reduce(DataFrame.unionByName, parts)
    pairs = _pairs(files, rules, group, keep, flags)

    rows = expand_matches(
        pairs.withColumn("pattern", F.col("rule.pattern")), [*keep, "rule"], code, context, context_rows, end_line,
        line_flags or {})
    labels = [f.name for f in pairs.schema["rule"].dataType.fields if f.name != "pattern"]
    found = [c for c in rows.columns if c not in (*keep, "rule")]
    return rows.select(*keep, *[F.col("rule")[n].alias(n) for n in labels], *found)


def expand_matches(
    pairs: DataFrame, carry: list[str], code: bool, context: bool, context_rows: bool, end_line: bool,
    line_flags: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """One row per match of ``pattern`` in ``text``.

    The row of a file holds its lines once; the matches are exploded from
    plain columns inside generated code, and each takes its line by position.
    So a file of one long line with very many matches needs memory for one
    line, not for one per match.
    """
    text, pattern = F.col("text"), F.col("pattern")

    def match(m: Column, i: Column, numbers: Column) -> Column:
        line = F.get(numbers, i)
        out = [i.cast("int").alias("match_no"), line.alias("line"), m.alias("match")]
        if end_line:
            out.append((line + tx.newlines(m)).cast("int").alias("line_end"))
        return F.struct(*out)

    def arrays(lines: Column, counts: Column) -> Column:
        matches = tx.let(tx.match_lines(counts), lambda numbers: F.transform(
            F.regexp_extract_all(text, pattern, F.lit(0)), lambda m, i: match(m, i, numbers)))
        out = [matches.alias("_matches")]
        if code:
            out.append(tx.on_matched_lines(counts, lambda n: tx.strip(F.get(lines, n - 1))).alias("_codes"))
        if context:
            out.append(tx.on_matched_lines(counts, lambda n: tx.context(lines, n)).alias("_contexts"))
        for name, test in line_flags.items():
            out.append(tx.on_matched_lines(counts, lambda n, test=test: test(F.get(lines, n - 1))).alias(f"_{name}"))
        if context_rows:
            out.append(lines.alias("_lines"))
        return F.struct(*out)

    found = tx.let(tx.lines_of(text), lambda lines: tx.let(
        tx.match_counts(text, lines, pattern), lambda counts: arrays(lines, counts)))
    rows = pairs.select(*carry, found.alias("_f")).select(*carry, "_f.*")
    rows = rows.withColumn("m", F.explode_outer("_matches")).where(F.col("m").isNotNull())
    at, last = F.col("m.line"), F.col("m.line_end" if end_line else "m.line")
    out = [F.col("m.match_no"), at.alias("line"), F.col("m.match")]
    if end_line:
        out.append(last.alias("line_end"))
    if code:
        out.append(F.get("_codes", at - 1).alias("code"))
    if context:
        out.append(F.get("_contexts", at - 1).alias("context"))
    out += [F.get(f"_{name}", at - 1).alias(name) for name in line_flags]
    if not context_rows:
        return rows.select(*carry, *out)
    out.append(tx.line_window(F.col("_lines"), at, last).alias("_around"))
    rows = rows.select(*carry, *out)
    # Read twice, so that the window is not inlined and stays in generated code.
    around = F.when(F.size("_around") > 0, tx.numbered_lines(F.col("_around"), F.col("line"), F.col("line_end" if end_line else "line")))
    return rows.withColumn("context_rows", around).drop("_around")

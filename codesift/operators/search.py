"""Pattern findings, ad-hoc searches and saved queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from codesift.catalog.queries import DANGEROUS_EVAL_PATTERN
from codesift.functions import text as tx
from codesift.operators.match import GENERIC, Rule, expand_matches, find_matches
from codesift.operators.ordering import numbered_in_groups
from codesift.operators.trigrams import Index, indexed_matches
from codesift.schemas import as_findings
from codesift.session import durable, durable_counted
from codesift.sources.catalogues import extension_of_language, pattern_rules, query_rules, saved_query_rules

MULTILINE = "dUm"

# Groups that are looked up by extension; the others are chosen by name.
EXTENSION_GROUPS = ["py", "js", "php", "java", "c", "cpp", "go", "rb"]


def rule_group(path: Column) -> Column:
    """Rule group of a file: its extension, or ``generic`` when it has none."""
    ext = F.ltrim(tx.extension(path), F.lit("."))
    return F.when(ext.isin(EXTENSION_GROUPS), ext).otherwise(GENERIC)


def rules_for_language(files: DataFrame) -> DataFrame:
    """Each file with the ids of the rules that apply to it."""
    by_group: dict[str, list[str]] = {}
    for r in pattern_rules(EXTENSION_GROUPS + [GENERIC]):
        by_group.setdefault(r.group, []).append(r.rule_id)
    table = F.split(F.try_element_at(
        tx.text_map({g: " ".join(ids) for g, ids in by_group.items()}), rule_group(F.col("path"))), " ")
    group = rule_group(F.col("path"))
    return files.select("file_id", "path", group.alias("rule_group"), F.explode(table).alias("rule_id"))


def match_rules(files: DataFrame, groups: list[str] | None = None, context: bool = False) -> DataFrame:
    """Pattern rules over files: by extension, or the named groups on all."""
    if groups is None:
        rules = pattern_rules(EXTENSION_GROUPS + [GENERIC])
        return find_matches(files, rules, rule_group(F.col("path")), context=context)
    return find_matches(files, pattern_rules(groups), None, context=context)


def pattern_findings(files: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return as_findings(match_rules(files, groups), "pattern", file=F.col("path"))


_SEARCH = {"flags": MULTILINE, "code": False, "context": True}


def _as_search_rows(matches: DataFrame) -> DataFrame:
    return matches.select("file_id", F.col("path").alias("file"), "match_no", "line", "match", "context",
                          F.lit("pattern_match").alias("type"))


def search_pattern(files: DataFrame, pattern: str) -> DataFrame:
    return _as_search_rows(find_matches(files, [Rule("search", pattern)], **_SEARCH))


def search_index(index: Index, pattern: str) -> DataFrame:
    """As ``search_pattern`` over the files of an index, reading candidates only."""
    return _as_search_rows(indexed_matches(index, [Rule("search", pattern)], **_SEARCH))


def function_patterns(name: str) -> list[str]:
    """Definitions and calls of a function, in the order they are tried."""
    n = re.escape(name)
    # The twelve forms and their order.
    return [
        rf"function\s+{n}\s*\(",
        rf"def\s+{n}\s*\(",
        rf"public.*function\s+{n}\s*\(",
        rf"private.*function\s+{n}\s*\(",
        rf"protected.*function\s+{n}\s*\(",
        rf"public.*static.*{n}\s*\(",
        rf"private.*static.*{n}\s*\(",
        rf"protected.*static.*{n}\s*\(",
        rf"public.*{n}\s*\(",
        rf"private.*{n}\s*\(",
        rf"protected.*{n}\s*\(",
        rf"{n}\s*\([^)]*\)",
    ]


def search_functions(files: DataFrame, names: list[str]) -> DataFrame:
    """Matches of the first form that occurs, per file and function name.

    The choice of the form is made inside the row, so nothing is shuffled.
    """
    flag = f"(?{MULTILINE})"
    choices = []
    for name in names:
        forms = [flag + p for p in function_patterns(name)]
        whens = " ".join(f"WHEN text RLIKE {tx.sql_text(p)} THEN {tx.sql_text(p)}" for p in forms)
        choices.append(
            f"CASE WHEN contains(text, {tx.sql_text(name)}) THEN "
            f"named_struct('function', {tx.sql_text(name)}, 'pattern', CASE {whens} END) END")
    choices = F.expr("array(" + ", ".join(choices) + ")")
    picked = (
        files.select("file_id", "path", "text", F.explode_outer(choices).alias("c"))
        .where(F.col("c.pattern").isNotNull())
        .select("file_id", "path", "text", "c.function", "c.pattern")
    )
    rows = expand_matches(
        picked, ["file_id", "path", "function"], code=False, context=True, context_rows=False, end_line=False,
        line_flags={})
    return rows.select("file_id", F.col("path").alias("file"), "function", "line", "match", "context",
                       F.lit("function_match").alias("type"))


_QUERY = {"flags": MULTILINE, "code": False, "context": True, "context_rows": True, "end_line": True}


def _as_query_rows(matches: DataFrame) -> DataFrame:
    return matches.select(
        "file_id", F.col("path").alias("file"), F.col("rule_id").alias("query_id"), "name", "match_no",
        F.col("line").alias("line_start"), "line_end", "match", "context", "context_rows", "severity")


def _query_rows(files: DataFrame, rules) -> DataFrame:
    return _as_query_rows(find_matches(files, rules, tx.extension(F.col("path")), **_QUERY))


def run_query_on_index(index: Index, query_id: str | None = None) -> DataFrame:
    """As ``run_query`` with the built-in queries, each on its candidates only."""
    rules = saved_query_rules(query_id)
    return _as_query_rows(indexed_matches(index, rules, lambda: tx.extension(F.col("path")), **_QUERY))


def run_query(files: DataFrame, query_id: str | None = None, queries: DataFrame | None = None) -> DataFrame:
    """One saved query, or all of them; built in, or from a query table."""
    if queries is None:
        return _query_rows(files, saved_query_rules(query_id))
    if query_id is not None:
        queries = queries.where(F.col("id") == query_id)
    return _query_rows(files, query_rules(queries))


def run_all_queries(files: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """All saved queries as findings."""
    rows = run_query(files, None, queries)
    return as_findings(
        rows, "query",
        rule_id=F.col("query_id"),
        line=F.col("line_start"), col=F.lit(0),
        type=F.concat(F.lit("Custom Query: "), F.col("name")),
        description=F.concat(F.lit("Custom query '"), F.col("name"), F.lit("' matched: "), F.col("match")),
        code=F.col("match"),
    )


def query_dangerous_eval(files: DataFrame) -> DataFrame:
    """The structural ``eval`` query on Python files."""
    rule = Rule("dangerous_eval", DANGEROUS_EVAL_PATTERN, ".py", ("eval",), {"severity": "High"})
    rows = find_matches(files, [rule], tx.extension(F.col("path")), code=False, context=True, context_rows=True)
    return rows.select(
        "file_id", F.col("path").alias("file"), F.col("rule_id").alias("query_id"),
        F.col("line").alias("line_start"), F.col("line").alias("line_end"), "match", "context",
        "context_rows", "severity")


def query_result_counts(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """Matches per query; queries without any keep a zero."""
    counts = matches.groupBy("query_id").agg(F.count("*").alias("n"))
    names = queries.select(F.col("id").alias("query_id"), F.col("name").alias("query_name"))
    return names.join(counts, "query_id", "left").select(
        "query_id", "query_name", F.coalesce("n", F.lit(0)).alias("result_count"))


# An id such as "a-2" is number 2 of the name "a".
_NUMBERED = r"^(.*)-([1-9][0-9]{0,8})$"


def _as_numbers(ids: DataFrame) -> DataFrame:
    """``id`` as (base_id, no): number 0 of itself, and its number of its stem."""
    whole = ids.select(F.col("id").alias("base_id"), F.lit(0).cast("long").alias("no"))
    stem = ids.where(F.col("id").rlike(_NUMBERED)).select(
        F.regexp_extract("id", _NUMBERED, 1).alias("base_id"), F.regexp_extract("id", _NUMBERED, 2).cast("long").alias("no"))
    return whole.unionByName(stem).distinct()


def _free_numbers(rows: DataFrame, taken: DataFrame, chunk_size: int) -> DataFrame:
    """The ``k``-th row of a base (from 0) gets the ``k``-th number not taken.

    The ``j``-th taken number ``t`` has ``t - j`` free ones below it, so it
    moves every row from place ``t - j`` on by one: a running count over rows
    and taken numbers laid on one axis, in chunks so that no base is one task.
    """
    numbered = numbered_in_groups(taken, ["base_id"], ["no"], F.floor(F.col("no") / chunk_size), "j")
    marks = numbered.select("base_id", (F.col("no") - F.col("j") + 1).alias("at"), F.lit(1).alias("mark"), F.lit(None).cast("long").alias("seq"))
    axis = rows.select("base_id", F.col("k").alias("at"), F.lit(0).alias("mark"), "seq").unionByName(marks)
    axis = axis.withColumn("chunk", F.floor(F.col("at") / chunk_size))
    sums = axis.groupBy("base_id", "chunk").agg(F.sum("mark").alias("n"))
    before = Window.partitionBy("base_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("base_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("base_id", "chunk").orderBy("at", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    axis = axis.withColumn("moved", F.sum("mark").over(inside)).where("mark = 0").join(starts, ["base_id", "chunk"])
    return axis.select("seq", (F.col("at") + F.col("moved") + F.col("start")).alias("no"))


def create_query_ids(new: DataFrame, existing: DataFrame, chunk_size: int = 10000) -> DataFrame:
    """Ids and defaults for new queries (``seq, name, pattern, language`` and
    any of ``description, severity, type, tags``).

    The id is the lower-cased name with dashes; later queries of one name, and
    names already taken, get ``-1``, ``-2``, ... in the order of ``seq``.
    ``existing`` holds the ids in use (column ``id``).  A name that itself ends
    in a number may ask for the id of another name's query: the earlier query
    keeps it, and the numbers are dealt again until no id is given twice.
    """
    base = F.replace(F.lower("name"), F.lit(" "), F.lit("-"))
    new = new.where(F.col("name").isNotNull() & F.col("pattern").isNotNull() & F.col("language").isNotNull())
    rows = numbered_in_groups(
        new.withColumn("base_id", base), ["base_id"], ["seq"], F.floor(F.col("seq") / chunk_size), "k")
    rows = durable(rows.withColumn("k", F.col("k").cast("long") - 1))
    taken = _as_numbers(existing)
    query_id = F.when(F.col("_no") == 0, F.col("base_id")).otherwise(F.concat_ws("-", "base_id", F.col("_no").cast("string")))
    # Only a name that looks like a numbered one can meet the id of another.
    may_meet = not rows.where(F.col("base_id").rlike(_NUMBERED)).isEmpty()
    while True:
        free = _free_numbers(rows.select("base_id", "k", "seq"), taken, chunk_size).select("seq", F.col("no").alias("_no"))
        given = rows.join(free, "seq").withColumn("query_id", query_id)
        if not may_meet:
            break
        given = durable(given)
        first = given.groupBy("query_id").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1")
        lost = given.join(first, "query_id").where(F.col("seq") > F.col("first")).select("base_id", F.col("_no").alias("no"))
        lost, n = durable_counted(lost.distinct())
        if n == 0:
            break
        taken = taken.unionByName(lost)
    rows = given

    def default(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name), value) if name in new.columns else value

    return rows.select(
        "seq", "name", "query_id",
        default("description", F.concat(F.lit("Custom query: "), F.col("name"))).alias("description"),
        default("severity", F.lit("Medium")).alias("severity"),
        default("type", F.lit("regex")).alias("type"),
        default("tags", F.array(F.lit("custom"))).alias("tags"),
        "language", "pattern",
    )

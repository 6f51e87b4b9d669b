"""Very many regex rules in one pass over the texts.

Testing every rule on every text costs as many scans as there are rules.  Most
rules imply a condition on trigrams (``trigrams.condition_of``); together these
are an index from trigrams to rules.  Each text is turned into its set of
trigrams once, which gives the few rules it may match, and only for these (file,
rule) pairs is a regex run, on the JVM's side.  What is added per rule is an
entry of the index, not a scan.  Rules that imply nothing are tested on every
text, as ``match.find_matches`` does.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codesift.functions import text as tx
from codesift.operators.match import Rule, expand_matches, find_matches
from codesift.operators.trigrams import Condition, condition_of, gram_of, grams_of
from codesift.session import local_table

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def keys_of(condition: Condition) -> set[str]:
    """Trigrams of which a match holds at least one: of an AND the part with the
    fewest, of an OR all parts.  Letters and signs before digits, as these tell
    more."""
    if isinstance(condition, str):
        return {condition}
    kind, parts = condition
    sets = [keys_of(p) for p in parts]
    return min(sets, key=lambda s: (len(s), sorted(s))) if kind == "and" else set().union(*sets)


class RuleIndex:
    """Which rules a set of trigrams may lead to."""

    def __init__(self, conditions: Sequence[Condition]) -> None:
        found: dict[int, list[int]] = {}
        for i, condition in enumerate(conditions):
            for g in keys_of(condition):
                found.setdefault(gram_of(g), []).append(i)
        self.grams = np.array(sorted(found), np.int64)
        self.rules = [found[g] for g in self.grams.tolist()]
        self.conditions = [_numbers(c) for c in conditions]

    def candidates(self, text: str) -> list[int]:
        held = grams_of(text)
        if not len(held) or not len(self.grams):
            return []
        at = np.searchsorted(self.grams, held)
        hits = np.flatnonzero(self.grams[np.minimum(at, len(self.grams) - 1)] == held)
        if not len(hits):
            return []
        maybe = {i for k in at[hits].tolist() for i in self.rules[k]}
        known = set(held.tolist()) if len(maybe) else set()
        return sorted(i for i in maybe if _holds(self.conditions[i], known))


def _numbers(condition: Condition):
    return gram_of(condition) if isinstance(condition, str) else (condition[0], tuple(_numbers(p) for p in condition[1]))


def _holds(condition, held: set[int]) -> bool:
    if isinstance(condition, int):
        return condition in held
    return (all if condition[0] == "and" else any)(_holds(p, held) for p in condition[1])


def candidate_rules(files: DataFrame, conditions: Sequence[Condition], keep: Sequence[str]) -> DataFrame:
    """``keep, text, rule_no`` for every rule a text may match, by number."""
    columns = [*keep, "text"]
    # The catalogue, which the driver holds, as plain tuples.
    catalogue = files.sparkSession.sparkContext.broadcast(list(conditions))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(catalogue.value)
        for batch in batches:
            found = [index.candidates(t.as_py() or "") for t in batch.column("text")]
            some = np.flatnonzero([bool(f) for f in found])
            if len(some):
                kept = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array([found[i] for i in some.tolist()], pa.list_(pa.int32()))], [*columns, "rule_nos"])

    rows = files.select(*columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("rule_nos", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(scan, schema).select(*columns, F.explode("rule_nos").alias("rule_no"))


def find_many(
    files: DataFrame, rules: Sequence[Rule], group: Column | None = None, keep: Sequence[str] = ("file_id", "path"),
    flags: str = tx.REGEX_FLAGS, code: bool = True, context: bool = False, context_rows: bool = False, end_line: bool = False,
    line_flags: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """As ``match.find_matches``, row for row, for catalogues of any size."""
    options = {"code": code, "context": context, "context_rows": context_rows, "end_line": end_line, "line_flags": line_flags or {}}
    names = sorted({n for r in rules for n in r.labels})
    rules = [replace(r, labels={**dict.fromkeys(names), **r.labels}) for r in rules]
    conditions = [condition_of(r.regex) for r in rules]
    known = [(r, c) for r, c in zip(rules, conditions) if c is not True]
    others = [r for r, c in zip(rules, conditions) if c is True]
    parts = [find_matches(files, others, group, keep, flags, **options)] if others or not known else []
    if known:
        fields = "rule_no int, rule_id string, pattern string, _wants string" + "".join(f", `{n}` string" for n in names)
        catalogue = local_table(files.sparkSession, [
            (i, r.rule_id, tx.java_regex(r.regex, flags), r.group if group is not None else None, *[r.labels[n] for n in names])
            for i, (r, _) in enumerate(known)], fields)
        grouped = files.withColumn("_group", group) if group is not None else files.withColumn("_group", F.lit(None).cast("string"))
        pairs = candidate_rules(grouped, [c for _, c in known], [*keep, "_group"]).join(catalogue, "rule_no")
        pairs = pairs.where((F.col("_wants").isNull() | (F.col("_wants") == F.col("_group"))) & F.expr("text RLIKE pattern"))
        carry = [*keep, "rule_id", *names]
        rows = expand_matches(pairs, carry, options["code"], context, context_rows, end_line, options["line_flags"])
        parts.append(rows)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

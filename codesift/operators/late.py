"""Matches and their lines apart: late materialisation.

With the code and the lines around in every row, a long line with very many
matches is written once per match.  Here a match holds its file and line number
only, and a second table holds each line that some match shows, once.
``with_lines_of`` puts them together for the matches that are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from codesift.functions import text as tx
from codesift.operators.match import Rule, find_matches
from codesift.session import durable

# Lines shown before and after the line of a match.
AROUND = 2


class Matches(NamedTuple):
    matches: DataFrame  # keep, rule_id, labels, match_no, line, match
    lines: DataFrame    # file_id, path, line, text: once each


def find_matches_late(files: DataFrame, rules: Sequence[Rule] | DataFrame, group: Column | None = None, **options) -> Matches:
    """``match.find_matches`` as two tables."""
    matches = durable(find_matches(files, rules, group, code=False, **options))
    at = matches.select("file_id", "path", "line").distinct()
    wanted = at.select("file_id", "path", F.explode(F.sequence(F.greatest(F.col("line") - AROUND, F.lit(1)), F.col("line") + AROUND)).alias("n"))
    # A file was one row, and so are the numbers of its lines.
    numbers = wanted.groupBy("file_id", "path").agg(F.collect_set("n").alias("_numbers"))
    held = files.select("file_id", "path", "text").join(numbers, ["file_id", "path"])
    shown = tx.let(tx.lines_of(F.col("text")), lambda lines: F.transform("_numbers", lambda n: F.struct(n.alias("line"), F.get(lines, n - 1).alias("text"))))
    rows = held.select("file_id", "path", shown.alias("_shown")).select("file_id", "path", F.inline("_shown"))
    return Matches(matches, durable(rows.where(F.col("text").isNotNull())))


def with_lines_of(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """``matches`` with ``code``, the trimmed line, and ``context``, the lines
    around, each made once per line and joined to its matches."""
    keys = ["file_id", "path", "line"]
    at = matches.select(*keys).distinct()
    near = at.select("*", F.explode(F.sequence(F.col("line") - AROUND, F.col("line") + AROUND)).alias("_n"))
    rows = near.join(lines.select("file_id", "path", F.col("line").alias("_n"), "text"), ["file_id", "path", "_n"])
    shown = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_n") == F.col("line"), F.col("text"))).alias("_code"),
        F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_near"))
    shown = shown.select(*keys, tx.strip(F.col("_code")).alias("code"), F.array_join(F.transform("_near", lambda x: x["text"]), "\n").alias("context"))
    return matches.join(shown, keys)

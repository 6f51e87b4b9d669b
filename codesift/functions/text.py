"""Column expressions over text: lines, matches, context, masking.

Everything here is a plain Column expression that runs in the JVM.  Text is
split on ``\\n`` only, so line numbers and line contents always agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# ``d``: only "\n" ends a line for "." and "$".  ``U``: \b \d \s \w and case
# folding follow Unicode, so accented words are words.
REGEX_FLAGS = "dU"

# White space as Python's str.strip() sees it.
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda variable is never inlined again by the optimizer, unlike a column
    of an earlier projection.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def java_regex(pattern: str, flags: str = REGEX_FLAGS) -> str:
    return f"(?{flags}){pattern}"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(_BLANKS))


def has_odd_case(text: Column) -> Column:
    """True when a character that upper() leaves alone may stand for an ASCII
    letter in a Unicode case-blind regex (Kelvin sign, dotted capital I)."""
    return F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))


def sql_text(value: str | None) -> str:
    """A text as a Spark SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values) -> Column:
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


def text_map(pairs: dict[str, str]) -> Column:
    """A constant lookup table; folded to one literal by the optimizer."""
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in pairs.items()) + ")")


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the text holds one of the words.  ``text`` should be a plain
    column or a bound variable: it is read once per word."""
    return F.exists(text_array(words), lambda w: F.contains(text, w))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def newlines(text: Column) -> Column:
    return F.size(lines_of(text)) - 1


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; names like ``.env`` have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def line_window(lines: Column, first: Column, last: Column, around: int = 2) -> Column:
    """Lines ``first - around`` to ``last + around`` (1-based), clamped."""
    start = F.greatest(first - around, F.lit(1))
    stop = F.least(last + around, F.size(lines))
    return F.slice(lines, start, F.greatest(stop - start + 1, F.lit(0)))


def context(lines: Column, line: Column, around: int = 2) -> Column:
    return F.array_join(line_window(lines, line, line, around), "\n")


def numbered_lines(window: Column, first: Column, last: Column, around: int = 2) -> Column:
    """The lines of a ``line_window`` with their numbers and whether they are
    part of the match."""
    start = F.greatest(first - around, F.lit(1))
    return F.transform(
        window,
        lambda content, i: F.struct(
            (start + i).cast("int").alias("line_num"),
            content.alias("content"),
            ((start + i >= first) & (start + i <= last)).alias("is_match"),
        ),
    )


def match_counts(text: Column, lines: Column, pattern: Column) -> Column:
    """Number of matches that start on each line.

    Each match is prefixed with one extra character; line ``i`` of the marked
    text is then longer than line ``i`` of the text by its number of matches.
    Linear in the text, exact for patterns that span lines or match nothing,
    and independent of which character is used as the mark.
    """
    marked = lines_of(F.regexp_replace(text, pattern, F.lit("\x01$0")))
    return F.zip_with(lines, marked, lambda a, b: F.length(b) - F.length(a))


def match_lines(counts: Column) -> Column:
    """Line number of every match, in match order."""
    return F.flatten(F.transform(counts, lambda n, i: F.array_repeat((i + 1).cast("int"), n)))


def on_matched_lines(counts: Column, build: Callable[[Column], Column]) -> Column:
    """``build(line number)`` for the lines that hold a match, null elsewhere.

    Built once per line, however many matches the line holds.
    """
    return F.transform(counts, lambda n, i: F.when(n > 0, build((i + 1).cast("int"))))


def html_escape(text: Column) -> Column:
    # Replacement order and entities.
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return F.coalesce(out, F.lit(""))


def mask_value(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2)))
    )


def shannon_entropy(token: Column) -> Column:
    """Bits per character of a short token, without leaving the row."""
    def of(chars: Column) -> Column:
        counts = F.transform(
            F.array_distinct(chars),
            lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars),
        )
        return F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return let(F.split(token, ""), of)

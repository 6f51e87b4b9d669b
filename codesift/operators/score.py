"""Risk score of a finding from its type and its code line.  Row-wise only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codesift.catalog import scoring as cat
from codesift.functions import text as tx


def base_severity(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(tx.text_map(cat.BASE_SEVERITY), kind), F.lit("Medium"))


def _word_factors(code: Column, words: list[str], sentence: str) -> Column:
    before, after = sentence.split("{}")
    found = F.filter(tx.text_array(words), lambda w: F.contains(code, w))
    return F.transform(found, lambda w: F.concat(F.lit(before), w, F.lit(after)))


def keyword_factors(code: Column) -> tuple[Column, Column]:
    """Raising and lowering sentences for the words in a lower-cased line."""
    return (
        tx.let(code, lambda c: _word_factors(c, cat.HIGH_RISK_WORDS, cat.HIGH_RISK_TEXT)),
        tx.let(code, lambda c: _word_factors(c, cat.LOW_RISK_WORDS, cat.LOW_RISK_TEXT)),
    )


def _no_texts() -> Column:
    return F.expr("CAST(array() AS ARRAY<STRING>)")


def _if(test: Column, sentence: str) -> Column:
    return F.when(test, F.array(F.lit(sentence))).otherwise(_no_texts())


def type_factors(kind: Column, code: Column) -> tuple[Column, Column]:
    """Further sentences for four types of finding."""
    command, sql = kind == "Command Execution", kind == "SQL Injection"

    def raising(c: Column) -> Column:
        return F.concat(
            _if(command & tx.contains_any(c, ["+", 'f"', "${", "%s"]), cat.DYNAMIC_COMMAND_TEXT),
            _if(sql & tx.contains_any(c, ["+", "concat"]), cat.CONCATENATED_SQL_TEXT),
            F.when(kind == "Hard-coded Credentials", _word_factors(c, cat.HARD_CODED_WORDS, cat.HARD_CODED_TEXT))
            .otherwise(_no_texts()))

    def lowering(c: Column) -> Column:
        asked = F.contains(c, F.lit("?")) & F.contains(c, F.lit("execute"))
        parameters = (asked | F.contains(c, F.lit("%s"))) & ~tx.contains_any(c, ["concatenat", "+"])
        return F.concat(
            _if(command & tx.contains_any(c, ["validate", "sanitize", "escape"]), cat.VALIDATED_COMMAND_TEXT),
            _if(sql & parameters, cat.PARAMETERIZED_SQL_TEXT),
            _if((kind == "XSS") & tx.contains_any(c, ["escape", "sanitize", "htmlspecialchars"]), cat.ENCODED_OUTPUT_TEXT))

    return tx.let(code, raising), tx.let(code, lowering)


def with_factors(findings: DataFrame) -> DataFrame:
    """Adds ``base_severity``, ``increasing`` and ``decreasing``."""
    code = F.lower(F.coalesce(F.col("code"), F.lit("")))
    words_up, words_down = keyword_factors(code)
    type_up, type_down = type_factors(F.col("type"), code)
    return findings.withColumns({
        "base_severity": base_severity(F.col("type")),
        "increasing": F.concat(words_up, type_up),
        "decreasing": F.concat(words_down, type_down),
    })


def risk_level(base: Column, increasing: Column, decreasing: Column) -> Column:
    value = F.when(base == "High", 3).when(base == "Low", 1).otherwise(2)
    value = value + F.least(F.size(increasing), F.lit(2)) - F.least(F.size(decreasing), F.lit(2))
    value = F.greatest(F.lit(1), F.least(value, F.lit(3)))
    return F.when(value == 3, "High").when(value == 2, "Medium").otherwise("Low")


def risk_confidence(increasing: Column, decreasing: Column) -> Column:
    return F.when((F.size(increasing) > 2) | (F.size(decreasing) > 2), "High").otherwise("Medium")


def risk_explanation(kind: Column, level: Column, increasing: Column, decreasing: Column) -> Column:
    def part(label: str, factors: Column) -> Column:
        first = F.array_join(F.slice(factors, 1, 2), "; ")
        return F.when(F.size(factors) > 0, F.concat(F.lit(f" {label}: "), first, F.lit("."))).otherwise("")

    return F.concat(
        F.lit("The "), kind, F.lit(" vulnerability is assessed as "), level, F.lit(" severity."),
        part("Risk factors", increasing), part("Mitigating factors", decreasing), F.lit(" (AI assessment)"))


def score_findings(findings: DataFrame) -> DataFrame:
    """Replaces severity and confidence by the assessed ones; the rule's own
    level stays in ``rule_severity``."""
    rows = with_factors(findings).withColumn("rule_severity", F.col("severity"))
    up, down = F.col("increasing"), F.col("decreasing")
    rows = rows.withColumns({
        "severity": risk_level(F.col("base_severity"), up, down),
        "confidence": risk_confidence(up, down),
    })
    return rows.withColumn("explanation", risk_explanation(F.col("type"), F.col("severity"), up, down))

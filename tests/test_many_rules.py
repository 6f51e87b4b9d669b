"""Catalogues in one pass, and matches without their lines, against find_matches."""

import os
import random
import time

from pyspark.sql import functions as F

from codesift.functions import text as tx
from codesift.operators import late, match, prefilter
from codesift.operators.match import Rule, find_matches
from codesift.sources import catalogues


def plain(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def corpus(spark, n=400):
    rng = random.Random(3)
    words = ["password", "=", "'abc'", "eval(", ")", "os.system", "\n", "  ", "rule7", "Rule12x", "İstanbul", "kelvin", "1234", "-----BEGIN RSA PRIVATE KEY-----"]
    rows = [(i, f"f{i}.{rng.choice(['py', 'js', 'txt'])}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(n)] + [(n, "none.py", None)]
    return spark.createDataFrame(rows, "file_id long, path string, text string")


RULES = [
    Rule("lit", r"password\s*=", None, (), {"severity": "High"}), Rule("any", r"\d+", ".py", (), {"severity": "Low"}),
    Rule("alt", r"(eval|exec)\(", ".js", (), {"type": "t"}), Rule("case", r"(?i)KELVIN|istanbul"), Rule("lines", r"^\s*os\.system$"),
    Rule("grouped", r"rule7", ".py"), Rule("never", r"no such text"), Rule("run", r"abc", run=r"'abc'")]


def test_same_rows_as_rule_by_rule(spark):
    files, group = corpus(spark), tx.extension(F.col("path"))
    for rules in (RULES, RULES[:1], RULES[1:2], catalogues.pattern_rules()):
        got = prefilter.find_many(files, rules, group, flags="dUm", context=True, end_line=True)
        want = find_matches(files, rules, group, flags="dUm", context=True, end_line=True)
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got, sorted(want.columns)) == plain(want, sorted(want.columns))
    assert prefilter.find_many(files.where("false"), RULES, group).count() == 0
    assert prefilter.find_many(files, [], group).count() == 0


def test_ten_thousand_rules_in_one_scan(spark):
    files = corpus(spark, 300)
    rules = [Rule(f"r{i}", rf"(?i)\brule{i}(x|y)?\b\s*=?") for i in range(10_000)]
    found = prefilter.find_many(files, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    began = time.time()
    rows = found.collect()
    one_pass = time.time() - began
    assert {r["rule_id"] for r in rows} == {"r7", "r12"}
    few = plain(find_matches(files, [rules[7], rules[12], rules[9_999]]), found.columns)
    assert sorted(map(str, rows)) == few
    # Two hundred of them, rule by rule, are slower than all ten thousand at once.
    began = time.time()
    assert {r["rule_id"] for r in find_matches(files, rules[:200]).collect()} == {"r7", "r12"}
    print(f"10,000 rules in one pass {one_pass:.1f} s, 200 rule by rule {time.time() - began:.1f} s")


def test_lines_are_stored_once(spark, tmp_path):
    files, rules = corpus(spark), catalogues.pattern_rules(["generic", "sensitive_data"]) + [Rule("w", r"\w+")]
    found = late.find_matches_late(files, rules)
    assert found.lines.groupBy("file_id", "path", "line").count().where("count > 1").count() == 0
    want = find_matches(files, rules, context=True)
    assert plain(late.with_lines_of(found.matches, found.lines), want.columns) == plain(want, want.columns)


def test_a_long_line_with_very_many_matches_is_small(spark, tmp_path):
    line = "ab " * 100_000 + "c" * (1 << 20)
    files = spark.createDataFrame([(1, "long.txt", "first\n" + line + "\nlast")], "file_id long, path string, text string")
    found = late.find_matches_late(files, [Rule("ab", "ab")])
    sizes = []
    for name, table in zip(("matches", "lines"), found):
        table.write.parquet(str(tmp_path / name))
        sizes.append(sum(os.path.getsize(tmp_path / name / f) for f in os.listdir(tmp_path / name)))
    assert found.matches.count() == 100_000 and sum(sizes) < 50 << 20
    some = late.with_lines_of(found.matches.where("match_no in (0, 99999)"), found.lines).collect()
    assert [(r["code"] == line, r["context"] == f"first\n{line}\nlast") for r in some] == [(True, True)] * 2


def test_rule_index():
    from codesift.operators.trigrams import condition_of

    index = prefilter.RuleIndex([condition_of(p) for p in ("abcdef", "abcxyz|klmno", "(?i)ABC.*xyz")])
    assert index.candidates("zz abcdef") == [0] and index.candidates("ABC klmno") == [1] and index.candidates("abc xyz") == [2]
    assert index.candidates("ab") == [] and index.candidates("") == [] and prefilter.RuleIndex([]).candidates("abc") == []
    assert match.NEVER

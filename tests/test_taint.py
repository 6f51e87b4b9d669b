"""Data flow against a plain closure, on hand-made and random programs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codesift.operators import facts as fx, taint

CYCLE = "a = input()\npad = 0\nb = a\na = b\nc = b + a\nprint(1)\neval(c)\n"


def closure(lines: list[tuple[str, str]], start: set[str], match: str) -> set[str]:
    seen, grew = set(start), True
    while grew:
        grew = False
        for target, text in lines:
            for var in list(seen):
                named = var in text if match == "substring" else re.search(rf"\b{re.escape(var)}\b", text)
                if named and target != var and target not in seen:
                    seen.add(target)
                    grew = True
    return seen


def test_cycle_ends_and_traces(files):
    facts = fx.fact_table(files({"a.py": CYCLE}))
    tainted = taint.taint_propagate(facts)
    assert {(r["var"], r["parent"], r["depth"]) for r in tainted.collect()} == {("a", None, 0), ("b", "a", 1), ("c", "a", 1)}
    steps = sorted((r["step"], r["variable"], r["line"]) for r in taint.taint_traces(taint.taint_to_sinks(facts, tainted), tainted).collect())
    assert steps == [(0, "a", 1), (1, "c", 5), (2, "sink", 7)]


def test_sanitizer_and_whole_words(files):
    facts = fx.fact_table(files({
        "a.py": "q = request.json()\nx = 1\ncursor.execute(escape(q))\nos.system(quit)\n",
        "b.py": "q = request.json()\nx = 1\nos.system(quit)\n"}))
    tainted = taint.taint_propagate(facts)
    assert taint.taint_to_sinks(facts, tainted).count() == 0
    loose = taint.taint_propagate(facts, match="substring")
    hits = taint.taint_to_sinks(facts, loose, match="substring")
    assert sorted((r["path"], r["line"], r["tainted_variable"]) for r in hits.collect()) == [("a.py", 4, "q"), ("b.py", 3, "q")]


def test_self_hits(files):
    facts = fx.fact_table(files({"a.py": "r = requests.get(u)\n"}))
    tainted = taint.taint_propagate(facts)
    assert taint.taint_to_sinks(facts, tainted).count() == 0
    assert taint.taint_to_sinks(facts, tainted, self_hits=True).count() == 1


def test_last_mark_of_a_variable_counts(files):
    facts = fx.fact_table(files({"a.py": "v = request.args.get(1)\nw = 1\n\n\nv = sys.argv()\n"}))
    row = {r["var"]: r for r in taint.taint_sources(facts).collect()}
    assert (row["v"]["origin"], row["v"]["line"]) == ("sys.argv", 5)


@pytest.mark.parametrize("match", ["identifier", "substring"])
def test_random_programs(files, match):
    rng = random.Random(7)
    names = ["a", "ab", "abc", "x1", "y", "value", "val", "long_name"]
    programs = {}
    for n in range(40):
        body = [(rng.choice(names), " + ".join(rng.sample(names, rng.randint(0, 2)) or ["1"])) for _ in range(25)]
        programs[f"p{n}.py"] = "start = input()\n\n" + "\n".join(f"{t} = {e}" for t, e in body[:12]) + "\nab = start\n" + "\n".join(
            f"{t} = {e}" for t, e in body[12:]) + "\n"
    got = {}
    for r in taint.taint_propagate(fx.fact_table(files(programs)), match=match).collect():
        got.setdefault(r["path"], set()).add(r["var"])
    for path, text in programs.items():
        lines = [(l.split(" = ")[0], l) for l in text.split("\n") if " = " in l]
        assert got[path] == closure(lines, {"start"}, match), path


@pytest.mark.parametrize("links", [12, 1000])
def test_long_chain(files, links):
    text = "v0 = input()\npad = 1\n" + "".join(f"v{i} = v{i - 1}\n" for i in range(1, links + 1)) + f"eval(v{links})\n"
    facts = fx.fact_table(files({"a.py": text}))
    tainted = taint.taint_propagate(facts)
    hits = taint.taint_to_sinks(facts, tainted)
    assert [(r["tainted_variable"], r["depth"]) for r in hits.collect()] == [(f"v{links}", links)]
    assert taint.taint_traces(hits, tainted).count() == links + 2


def test_one_long_line(files):
    """A generated file of one line: facts do not repeat it, joins do not square it."""
    n = 20_000
    text = "q = request.args.get(1);" + ";".join(f"v{i} = q" for i in range(n)) + ";" + ";".join(["f(q)"] * n) + ";os.system(q)"
    facts = fx.fact_table(files({"a.py": text}))
    size = facts.agg(F.sum(F.coalesce(F.length("code"), F.lit(0)) + F.coalesce(F.length("context"), F.lit(0))).alias("n")).first()["n"]
    assert size <= 2 * len(text) + 10
    assert taint.taint_propagate(facts).count() == n + 1
    hits = taint.taint_to_sinks(facts, taint.taint_sources(facts), self_hits=True)
    assert [(r["tainted_variable"], r["code"] == text) for r in hits.collect()] == [("q", True)]
    assert [r["code"] == text for r in fx.dangerous_calls(facts).collect()] == [True]


def test_hits_are_found_once_for_their_steps(spark, files):
    facts = fx.fact_table(files({"a.py": "q = request.args.get('a')\nz = 1\nr = q\ncursor.execute(r)\n"}))
    tainted = taint.taint_propagate(facts)
    seen = spark.sparkContext.accumulator(0)

    def mark(line):
        seen.add(1)
        return line

    hits = taint.taint_to_sinks(facts, tainted)
    n = hits.count()
    marked = hits.withColumn("line", F.udf(mark, "int")("line"))
    edges = taint.trace_edges(marked, tainted).collect()
    assert n and len(edges) >= 2 * n and seen.value == n

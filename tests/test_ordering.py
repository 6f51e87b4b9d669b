"""Numbers and neighbours with one hot key, against plain Python."""

import random

from pyspark.sql import functions as F

from codesift.operators import report
from codesift.operators.flow import reachable
from codesift.operators.ordering import next_in_groups, numbered, numbered_in_groups


def rows(n=3000):
    rng = random.Random(3)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", rng.randrange(500), i) for i in range(n)]


def test_numbered(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, v long, id long").repartition(7)
    got = numbered(df, [F.col("v").desc(), F.col("id")]).collect()
    want = {r[2]: i for i, r in enumerate(sorted(data, key=lambda r: (-r[1], r[2])), 1)}
    assert {r["id"]: r["row_no"] for r in got} == want


def test_numbered_in_groups(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, v long, id long")
    got = numbered_in_groups(df, ["k"], ["v", "id"], F.floor(F.col("v") / 50)).collect()
    want, seen = {}, {}
    for k, v, i in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert {r["id"]: r["row_no"] for r in got} == want


def test_next_in_groups(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, v long, id long")
    got = {(r["k"], r["src"], r["dst"]) for r in next_in_groups(df, ["k"], ["v", "id"], F.floor(F.col("v") / 9), "id").collect()}
    order = sorted(data, key=lambda r: (r[0], r[1], r[2]))
    assert got == {(a[0], a[2], b[2]) for a, b in zip(order, order[1:]) if a[0] == b[0]}


def test_reachable_in_a_graph_with_cycles(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)] + [(0, i) for i in range(60, 160)] + [(159, 0)]
    df = spark.createDataFrame(edges, "src long, dst long")
    starts = spark.createDataFrame([(1,), (159,)], "node long")
    for depth in (0, 2, 50):
        want, frontier = {1: 0, 159: 0}, {1, 159}
        for d in range(1, depth + 1):
            frontier = {b for a, b in edges if a in frontier} - set(want)
            want |= {n: d for n in frontier}
        assert {r["node"]: r["depth"] for r in reachable(df, starts, depth).collect()} == want


def test_reachable_in_chains_of_any_length(spark):
    from codesift.operators.flow import reachable_in_chains

    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (50, 300)]
    df = spark.createDataFrame(edges, "src long, dst long")
    starts = spark.createDataFrame([(3,), (60,)], "node long")
    want = {i: i - 3 for i in range(3, 60)} | {i: i - 60 for i in range(60, 101)} | {300: 48}
    assert {r["node"]: r["depth"] for r in reachable_in_chains(df, starts).collect()} == want


def test_findings_are_found_once_for_the_sort(spark):
    seen = spark.sparkContext.accumulator(0)

    def level(i):
        seen.add(1)
        return ("Low", "High", "Medium")[i % 3]

    rows = spark.range(100).select(
        F.udf(level, "string")("id").alias("severity"), F.lit("f").alias("file"), F.col("id").alias("file_id"), F.lit(1).alias("line"),
        F.lit("r").alias("rule_id"), F.lit(0).alias("match_no"))
    got = [r["severity"] for r in report.severity_sort(rows).collect()]
    assert got == ["High"] * 33 + ["Medium"] * 33 + ["Low"] * 34
    assert seen.value == 100

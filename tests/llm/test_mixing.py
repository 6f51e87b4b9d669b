"""Targets by hand; copies within their limits, near their targets, rerun alike."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from codesift.llm import mixing as mx


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] for s in full} | {s: rest * weight[s] / total for s in open_}
        above = {s for s in open_ if target[s] >= most * sizes[s]}
        if not above:
            return target
        full |= above
        if full == set(names):
            return {s: most * sizes[s] for s in names}


def test_query(spark):
    rows = mx.op7_pivotal_mix(spark, SF).collect()
    again = mx.op7_pivotal_mix(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {d: len([w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in r["text"] or "").split(" ") if w]) for d, r in docs.items()}
    by_source = {}
    for d, r in docs.items():
        by_source[r["source"]] = by_source.get(r["source"], 0) + size[d]
    target, taken = water(by_source), {}
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by_source[s]
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    # A source misses its target by less than its largest document.
    for s in target:
        assert abs(taken[s] - target[s]) <= max(size[d] for d, r in docs.items() if r["source"] == s)


def test_many_units_round_to_their_sum(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        (F.col("id") % 400 + 1).alias("size"))
    got = mx.mixed(rows, leaf=16).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    for r in got:
        assert r["most"] <= 2 and abs(r["taken"] / r["target"] - 1) < 0.01


def test_odd_rows(spark):
    rows = [(1, None, None, 9), (2, "", "b", 9), (3, "a b c", None, 9), (3, "a b c", None, 9), (None, "x y", "a", 9), (None, "x y z", "a", 9), (4, "w " * 5000, "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = mx.repeated(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    # Repeats are two documents: none takes more than two copies.
    assert set(got) <= set(rows) and got.count(rows[2]) <= 4
    assert mx.repeated(docs.where("false")).count() == 0
    nothing = docs.where("doc_id < 3").select("doc_id", "source", F.lit(0).cast("long").alias("size"))
    assert [r["target"] for r in mx.mixed(nothing).collect()] == [0.0, 0.0]


def test_plan_is_native(spark):
    plan = mx.op7_pivotal_mix(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_row_many_times_meets_its_target(spark):
    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot").alias("source"), F.lit(100).cast("long").alias("size"))
    cold = spark.range(3_000).select((F.col("id") + 100).alias("doc_id"), F.lit("cold").alias("source"), (F.col("id") % 50 + 1).alias("size"))
    other = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(40).cast("long").alias("size"))
    rows = hot.unionByName(cold).unionByName(other).repartition(8)
    got = mx.mixed(rows).groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"),
        F.max("size").alias("largest"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()
    assert {r["source"]: r["n"] for r in got} == {"hot": 100_000, "cold": 3_000, None: 5_000}
    for r in got:
        assert abs(r["taken"] - r["target"]) <= r["largest"] and r["most"] <= 2
        assert r["source"] == "cold" or r["most"] - r["least"] <= 1
    docs = rows.select("doc_id", "source", F.repeat(F.lit("w "), F.col("size").cast("int")).alias("text"))
    taken = mx.repeated(docs).groupBy("source").agg(F.count("*").alias("rows")).collect()
    want = {r["source"]: r["taken"] / r["largest"] for r in got if r["source"] != "cold"}
    assert {r["source"]: r["rows"] for r in taken if r["source"] != "cold"} == want

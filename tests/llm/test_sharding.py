"""Shards by their law; slots without gaps; a round trip through files."""

import zlib

from conftest import SF
from pyspark.sql import functions as F

from codesift.llm import sharding as sh


def test_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sh.op8_external_shuffle(spark, SF).collect()
    assert len(rows) == len(docs)
    slots = {}
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]])
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    for s in slots.values():
        assert sorted(x for x, _ in s) == list(range(len(s)))
    order = [[d for _, d in sorted(s)] for s in slots.values()]
    assert any(o != sorted(o) for o in order)


def test_small_buckets_split_a_hot_key(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit(1).alias("slot"))
    got = sh.shuffled(rows, 4, bucket_bytes=1000)
    buckets = got.groupBy("shard", "bucket").count().agg(F.max("count")).first()[0]
    assert buckets < 100
    assert got.where("key = 5").select("shard").distinct().count() == 1
    for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect():
        assert r["n"] == r["m"] + 1 == r["d"]
    again = sh.shuffled(rows.repartition(7), 4, bucket_bytes=1000)
    key = ["key", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))


def test_repeated_rows_are_parted(spark, monkeypatch):
    monkeypatch.setattr(sh, "REPEATS", 50)
    rows = spark.range(1000).select(
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise("other").alias("text"))
    got = sh.shuffled(rows, 4, bucket_bytes=500).where("key = 5").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in got) == 501 and max(r["count"] for r in got) <= 250


def test_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sh.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert back.select("shard_no").distinct().count() == 5


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", "a"), (2, "é" * 200_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sh.shuffled(docs, 3).select("row.*", "size").collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == [("1", 16), ("1", 16), ("2", 400_016), ("None", 16)]
    assert sh.shuffled(docs.where("false"), 3).count() == 0

"""Two-pass external shuffle of records into shards.

Pass one scatters every record by seeded hashes into buckets that fit in the
memory of one task and writes them durably; pass two takes one bucket at a
time, shuffles it by Fisher-Yates and gives its records their places.

Law ``key``: a record's shard depends on ``doc_id`` and the number of shards
alone.  It is the shard whose seeded hash with the id is largest, so one more
shard takes records only into itself.

Defined cases: a null text counts as empty, a null id is an id like any other;
rows that repeat a doc_id go to one shard, as the law has it, but not to one
bucket: their texts part them, or a drawn number where the texts repeat too; an empty table gives no rows; further columns are kept by
``shuffled`` under their names.
"""

from __future__ import annotations

import random
import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from codesift.llm.common import packed, table, text_or_empty
from codesift.session import durable

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 20_011
BUCKET_BYTES = 16 << 20
REPEATS = 10_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the largest hash; ties go to the larger number."""
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")))
    return F.array_max(tries)["s"]


def _fisher_yates(n: int, rng: random.Random) -> list[int]:
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = rng.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return order


# What rows with the same id and text have in common.
_SAME = ["key", "size", "text_crc32"]


def _salted(sized: DataFrame) -> DataFrame:
    """``salt`` parts the rows that repeat an id and text more than
    ``REPEATS`` times, which no hash of theirs can.  It is drawn while the
    scattered rows are written, so a repeated task writes all of its own."""
    many = durable(sized.groupBy(*_SAME).agg(F.count("*").alias("n")).where(F.col("n") > REPEATS))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in _SAME]
    drawn = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("m.n") / REPEATS))
    rows = sized.alias("r").join(many.alias("m"), same, "left")
    return rows.select("r.*", F.coalesce(F.when(F.col("m.n").isNotNull(), drawn), F.lit(0)).alias("salt"))


def shuffled(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
    bucket_bytes: int = BUCKET_BYTES, seed: int = SEED,
) -> DataFrame:
    """Every record as ``row`` with ``shard``, ``bucket``, ``size``,
    ``text_crc32`` and its ``slot``, counted from 0 without gaps in its shard."""
    body = text_or_empty(text)
    sized = packed(
        docs, key=F.col(key), size=F.octet_length(body).cast("long") + 16, text_crc32=F.crc32(body.cast("binary")))
    # Buckets per shard follow the bytes of the whole table.
    total = sized.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    scattered = durable(_salted(sized).withColumns({
        "shard": shard_of(F.col("key"), shards, seed),
        "bucket": F.pmod(F.xxhash64(F.lit(seed + 1), *_SAME, "salt"), F.lit(buckets)).cast("int")}).drop("salt"))

    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    def deal(ids: tuple, bucket: pa.Table) -> pa.Table:
        # The order of arrival says nothing: sort first, then shuffle.
        bucket = bucket.take(pc.sort_indices(
            bucket.select(_SAME), sort_keys=[(n, "ascending") for n in _SAME]))
        rng = random.Random(f"{seed}/{ids[0].as_py()}/{ids[1].as_py()}")
        bucket = bucket.take(pa.array(_fisher_yates(bucket.num_rows, rng), pa.int64()))
        return bucket.append_column("at", pa.array(range(bucket.num_rows), pa.int64()))

    schema = T.StructType([*scattered.schema.fields, T.StructField("at", T.LongType())])
    dealt = scattered.groupBy("shard", "bucket").applyInArrow(deal, schema)
    return dealt.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("at")).drop("at", "start")


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """One folder per shard; each file holds whole buckets in slot order."""
    rows = shuffled(docs, shards, **options)
    (rows.repartition("shard", "bucket").sortWithinPartitions("shard", "slot")
        .select("row.*", F.col("shard").alias("shard_no"), "slot")
        .write.partitionBy("shard_no").parquet(path))


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = shuffled(docs, 40)
    return rows.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", shard_of(F.col("key"), 41).cast("int").alias("grown_shard"))

"""Row numbers and neighbours in an order, without one task per group.

A window over a key puts a whole key into one task.  The helpers here cut
each key into chunks of its order first, work inside (key, chunk), and stitch
the chunks together with a table that has one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codesift.session import durable


def _running_start(sizes: DataFrame, keys: list[str], chunk: str, count: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*keys, chunk, F.coalesce(F.sum(count).over(before), F.lit(0)).alias("_start"))


def numbered(rows: DataFrame, order: list[Column], name: str = "row_no", few_parts: bool = False) -> DataFrame:
    """1-based row numbers in a total order over the whole table.

    Range partitioning on the full order splits any hot key; the sorted rows
    are cut durably so both uses see the same partitions, and one small row
    per partition gives each its first number.
    """
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ids = durable(ids.withColumn("_id", F.monotonically_increasing_id()))
    # The id holds the partition in its upper bits and the position below.
    ids = ids.withColumns({
        "_part": F.shiftright("_id", 33),
        "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1,
    })
    sizes = ids.groupBy("_part").agg(F.max("_pos").alias("_n")).withColumn("_all", F.lit(0))
    starts = _running_start(sizes, ["_all"], "_part", "_n").drop("_all")
    if few_parts:
        starts = durable(starts)
    return (
        ids.join(starts, "_part")
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_id", "_part", "_pos", "_start")
    )


def numbered_in_groups(
    rows: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "row_no"
) -> DataFrame:
    """1-based row numbers within ``keys``; ``chunk`` must not decrease along
    ``order``, so a hot key is numbered by many tasks."""
    rows = rows.withColumn("_chunk", chunk)
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    starts = _running_start(sizes, keys, "_chunk", "_n")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        rows.join(starts, [*keys, "_chunk"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside))
        .drop("_chunk", "_start")
    )


def next_in_groups(
    rows: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str
) -> DataFrame:
    """Edges ``(keys, src, dst)`` from each row to the next one of its key.

    Inside a chunk the neighbour is the next row; the last row of a chunk is
    linked to the first row of the next chunk that is not empty.
    """
    rows = rows.select(*keys, *[c for c in order if c not in keys], value, chunk.alias("_chunk"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    within = rows.withColumn("dst", F.lead(value).over(inside)).where(F.col("dst").isNotNull())
    place = F.struct(*order)
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last"))
    across = ends.select(
        *keys, F.col("_last").alias("src"),
        F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("dst"),
    ).where(F.col("dst").isNotNull())
    return within.select(*keys, F.col(value).alias("src"), "dst").unionByName(across)

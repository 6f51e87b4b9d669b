"""Small pieces that several operators of this folder share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# White space and words as every operator here counts them.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """Each row as one struct ``row``, so that no column of the caller can
    clash with the names an operator adds beside it."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def columns_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of some columns of a batch as Python values, one row at a time."""
    return zip(*[(v.as_py() for v in batch.column(n)) for n in names])


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))

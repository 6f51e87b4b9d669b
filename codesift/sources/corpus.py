"""Reading a corpus: a directory tree, or a table of texts, to ``files`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codesift.catalog.languages import BINARY_PROBE_CHARS, MAX_FILE_BYTES, MAX_FILES
from codesift.functions import text as tx
from codesift.sources.tree import read_tree


def decode_text(content: Column) -> Column:
    """UTF-8 text with every bad byte sequence replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def is_text(content: Column) -> Column:
    """The first 1,024 characters decode; four bytes each hold any of them."""
    head = F.substring(content, 1, 4 * BINARY_PROBE_CHARS).cast("string")
    return F.is_valid_utf8(F.substring(head, 1, BINARY_PROBE_CHARS))


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Visible files: ``path, modificationTime, length, content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_corpus(
    spark: SparkSession,
    path: str,
    max_bytes: int | None = MAX_FILE_BYTES,
    skip_binary: bool = False,
    glob: str | None = None,
    hidden: bool = True,
) -> DataFrame:
    """All files below ``path`` that can be read and are within the size cap.

    ``hidden=False`` leaves out names such as ``.env`` and ``__init__.py`` and
    reads through Spark's own file source.
    """
    if hidden:
        raw = read_tree(spark, path, max_bytes, glob).where("error IS NULL")
    else:
        raw = read_binary(spark, path, glob)
        if max_bytes is not None:
            raw = raw.where(F.col("length") <= max_bytes)
    if skip_binary:
        raw = raw.where(is_text(F.col("content")))
    return _as_files(raw)


def read_corpus_in_full(
    spark: SparkSession, path: str, max_bytes: int | None = MAX_FILE_BYTES, glob: str | None = None,
) -> DataFrame:
    """As ``read_corpus`` with hidden names, and a row with ``error`` and without
    a text for every folder that cannot be listed and every file that cannot be
    read or is over the cap: nothing vanishes."""
    raw = read_tree(spark, path, max_bytes, glob)
    return _as_files(raw, "error")


def _as_files(raw: DataFrame, *more: str) -> DataFrame:
    return raw.select(
        F.xxhash64("path").alias("file_id"),
        "path",
        tx.extension(F.col("path")).alias("ext"),
        F.col("length").alias("size"),
        decode_text(F.col("content")).alias("text"),
        *more,
    )


def size_cap(files: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """Files of at most ``max_bytes``; all with ``None``."""
    return files if max_bytes is None else files.where(F.col("size") <= max_bytes)


def max_files_cap(files: DataFrame, n: int = MAX_FILES) -> DataFrame:
    """The first ``n`` files by path: a top-n, not a full sort."""
    return files.orderBy("path", "file_id").limit(n)


def spread(files: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster.

    Each split is at most one scan partition, so an input this narrow is small
    and the shuffle is too; a wide input is returned as it is.
    """
    width = files.sparkSession.sparkContext.defaultParallelism
    if files.rdd.getNumPartitions() >= width:
        return files
    return files.repartition(width, "file_id")

"""Exact duplicates by a minimal perfect hash over historical digests.

The distinct digests of the history are dealt into parts by their first bytes.
Each part gets a minimal perfect hash: levels of bit arrays, where a digest
rests on the first level whose bit it has to itself; its slot is the number of
set bits before its own.  Slots hold full digests and the locator of the row
that stays.  A new digest is looked up in its part, and the digest in the slot
is compared byte by byte; members are repeats of the history, nonmembers are
grouped among themselves.

Equal texts are those equal after each run of white space has become one
space.  Defined cases: a null text is an empty text; the smallest doc_id stays,
a null id only where all are null; of rows that repeat text and doc_id the
first stays and the others go; an empty table gives no rows.
"""

from __future__ import annotations


import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codesift.llm.common import BLANK, packed, table, text_or_empty
from codesift.session import durable

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_DIGESTS = 200_000
LEAST_PARTS = 64
_GAMMA = 2


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), BLANK, " ").cast("binary"), 256))


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.view("<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Place of each digest on a level; the level turns the digest's words."""
    with np.errstate(over="ignore"):
        h = words[:, level % 4] ^ (words[:, (level // 4 + 1) % 4] * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(bits)).astype(np.int64)


def build(digests: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the levels for distinct 32-byte digests."""
    left, levels = _words(digests), []
    while len(left):
        bits = max(64, _GAMMA * len(left))
        at = _place(left, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """Slot of each digest; -1 for one that certainly was not built in."""
    words = _words(digests)
    out, open_, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, alone in enumerate(levels):
        rank = np.cumsum(alone)
        at = _place(words[open_], level, len(alone))
        hit = alone[at]
        out[open_[hit]] = base + rank[at[hit]] - 1
        open_, base = open_[~hit], base + int(rank[-1])
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, parts: int) -> DataFrame:
    """One row per part of ``history(digest, locator, copies)``: the levels and
    the slots with digest, locator and number of copies."""

    def one(ids: tuple, rows: pa.Table) -> pa.Table:
        digests = _matrix(rows["digest"])
        levels = build(digests)
        at = np.argsort(slots(levels, digests))
        rows = rows.take(pa.array(at))
        return pa.table({
            "part": pa.array([ids[0].as_py()], pa.int32()),
            "levels": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
            "bits": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
            "digests": pa.array([b"".join(rows["digest"].to_pylist())], pa.binary()),
            "locators": pa.array([rows["locator"].to_pylist()], pa.list_(pa.int64())),
            "copies": pa.array([rows["copies"].to_pylist()], pa.list_(pa.int64())),
        })

    schema = "part int, levels array<binary>, bits array<bigint>, digests binary, locators array<bigint>, copies array<bigint>"
    return history.withColumn("part", part_of(parts)).groupBy("part").applyInArrow(one, schema)


def part_of(parts: int) -> Column:
    first = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    return F.pmod(first, F.lit(parts)).cast("int")


def look_up(new: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """``new(digest, locator, copies)`` of distinct digests, with the history's
    locator and copies where the slot's digest is equal in all bytes."""

    def one(ids: tuple, rows: pa.Table, built: pa.Table) -> pa.Table:
        n = rows.num_rows
        old, copies = np.zeros(n, np.int64), np.zeros(n, np.int64)
        null_old, member = np.ones(n, bool), np.zeros(n, bool)
        if n and built.num_rows:
            part = built.to_pylist()[0]
            levels = [np.unpackbits(np.frombuffer(x, np.uint8), count=b).astype(bool) for x, b in zip(part["levels"], part["bits"])]
            digests, held = _matrix(rows["digest"]), np.frombuffer(part["digests"], np.uint8).reshape(-1, 32)
            at = slots(levels, digests)
            member = (at >= 0) & (held[at] == digests).all(axis=1)
            locators = np.array([-1 if x is None else x for x in part["locators"]], np.int64)
            null_locator = np.array([x is None for x in part["locators"]])
            old[member], null_old[member] = locators[at[member]], null_locator[at[member]]
            copies[member] = np.array(part["copies"], np.int64)[at[member]]
        return pa.table({
            "digest": rows["digest"], "locator": rows["locator"], "copies": rows["copies"],
            "member": pa.array(member), "old_locator": pa.array(old, mask=null_old), "old_copies": pa.array(copies)})

    schema = "digest binary, locator bigint, copies bigint, member boolean, old_locator bigint, old_copies bigint"
    left = new.withColumn("part", part_of(parts)).groupBy("part")
    return left.cogroup(index.groupBy("part")).applyInArrow(one, schema)


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest, combined before the shuffle."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("locator"), F.count("*").alias("copies"))


def winners(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, group_size`` of ``rows(doc_id, digest)``.

    The table is taken as two loads: ids up to the middle of the id range are
    the history, the others are new.  The history's digests are built into the
    index, the new ones looked up in it; nonmembers form groups of their own.
    """
    span = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).first()
    middle = ((span["a"] or 0) + (span["b"] or 0)) // 2
    parts = max(LEAST_PARTS, -(-span["n"] // PART_DIGESTS))
    past = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    history = digest_groups(rows.where(past))
    index = durable(build_index(history, parts))
    met = durable(look_up(digest_groups(rows.where(~past)), index, parts))
    # What the new load adds to a group of the history, and the groups of its own.
    members = met.where("member").select("digest", F.col("copies").alias("more"))
    old = history.join(members, "digest", "left").select(
        "digest", F.col("locator").alias("keep_id"), (F.col("copies") + F.coalesce("more", F.lit(0))).alias("group_size"))
    own = met.where("NOT member").select(
        "digest", F.col("locator").alias("keep_id"), F.col("copies").alias("group_size"))
    return old.unionByName(own)


def grouped(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, digest, ...)`` with keep_id, group_size and kept."""
    found = winners(rows.select("doc_id", "digest"))
    copy = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy(F.lit(1)))
    # Rows that repeat id and text are told apart by a number.
    return (
        rows.withColumn("copy", copy).join(found, "digest")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).drop("copy"))


def unique_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), digest=text_digest())
    keys = durable(rows.select("doc_id", "digest"))
    kept = grouped(keys).where("kept").select("doc_id", "digest")
    same = F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.digest") == F.col("k.digest"))
    left = rows.alias("r").join(kept.alias("k"), same, "left_semi")
    # A row that repeats id and text has the same key as the one that stays.
    repeated = keys.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "digest")
    once = left.join(repeated.alias("k"), same, "left_anti")
    again = left.join(repeated.alias("k"), same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return once.unionByName(again).select("row.*")


def op1_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")))
    return grouped(rows).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

"""Bottom-k sketches of shingle hashes as document fingerprints.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's shingles
of five lower-cased words (fewer words: one shingle of all; none: no hash).
Sketches merge by taking the smallest of both, so parts of a text or of a
corpus can be sketched apart.  The smallest of the union of two sketches are a
sample of the union of the sets: the share found in both estimates the
resemblance; with the distinct counts it gives the containment.

Defined cases: a null text is an empty text; two empty texts resemble each
other fully, an empty and another one not at all; rows that repeat an id follow
each other in the order of their texts; null ids come last; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codesift.llm.common import columns_of, table, text_or_empty
from codesift.llm.simhash import hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 128
WORDS = 5


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    return np.unique(hashes(text, words))[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of either text that are in both."""
    if not len(a) and not len(b):
        return 1.0
    union = merged(a, b, k)
    return int((np.isin(union, a) & np.isin(union, b)).sum()) / len(union)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Exact below k, else from the share of the range that k hashes take."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[-1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that are in ``b`` too."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return min(1.0, both / distinct_shingles(a, k))


def as_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def merge_sketches(rows: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key of sketches as text.  Hashes are rows here, so a key
    with any number of parts is combined before the shuffle, not collected."""
    pieces = F.transform(
        F.sequence(F.lit(0), (F.length(column) / 16).cast("int") - 1), lambda i: F.substring(F.col(column), i * 16 + 1, F.lit(16)))
    each = rows.select(*keys, F.explode_outer(F.when(F.length(column) > 0, pieces)).alias("h")).distinct()
    # Hashes of a hot key are cut to the k smallest in chunks first.
    chunk = F.substring("h", 4, 2)
    for by in ([*keys, chunk], keys):
        w = Window.partitionBy(*by).orderBy(F.col("h").asc_nulls_last())
        each = each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
    return each.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("h")), "").alias(column))


# --- texts beside the next one in order ------------------------------------------


def _row(doc_id, text, next_text, k, words, mine, others) -> dict:
    n = len(text)
    cut = n // 4
    edited = text[:n - cut] + (next_text or "")[:cut] if cut else text
    changed = mine if edited == text else sketch(edited, k, words)
    return {
        "doc_id": doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": as_text(mine), "edited_fingerprint": as_text(changed),
        "near_edited": resemblance(mine, changed, k), "near_next": resemblance(mine, others, k)}


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DEALT = pa.schema([
    ("part", pa.int64()), ("guest", pa.bool_()), ("last", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("text", pa.binary())])
_FLUSH = 4 << 20
# Bytes of a range, with so many for a row beside its text; ranges and keys
# tried for each, which the driver holds.
RANGE_BYTES = 4 << 20
ROW_BYTES = 1 << 10
MOST_RANGES = 20_000
_TRIED = 20


def range_starts(keys: DataFrame) -> list[tuple]:
    """First keys of ranges of about equal size in the order of ``keys(last,
    doc_id, tie, size)``.  Each is the key of a row, the first the smallest.

    Their number follows the bytes and rows of the table up to ``MOST_RANGES``;
    ranges are read as streams, so larger ones need no more memory.
    """
    key = F.struct("last", "doc_id", "tie")
    seen = keys.agg(F.min(key).alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if not seen["n"]:
        return []
    ranges = min(MOST_RANGES, max(1, -(-seen["bytes"] // RANGE_BYTES)))
    share = min(1.0, ranges * _TRIED / seen["n"])
    tried = keys.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    tried = sorted({(r["last"], r["doc_id"] or 0, r["tie"]) for r in tried.select("last", "doc_id", "tie").collect()})
    first = (seen["first"]["last"], seen["first"]["doc_id"] or 0, seen["first"]["tie"])
    return [first, *[k for k in tried[_TRIED::_TRIED] if k > first]]


def beside_next(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each document's sketch beside its edited text's and the next document's.

    The texts are dealt once, compressed, by ranges of (doc_id, hash of the
    text), and each range is read in order with one row held back.  The first
    document of a range also goes to the range before it, as a guest at its
    end; the first of all to the last range.  Ranges are fixed by the keys
    they start with, so a repeated task deals alike.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select(
        F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    starts = range_starts(body.select("last", "doc_id", "tie", (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long").alias("size")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out, size = [], 0
            for last, doc_id, tie, text in columns_of(batch, "last", "doc_id", "tie", "text"):
                key = (last, doc_id or 0, tie)
                part = bisect.bisect_right(starts, key) - 1
                row = {"part": part, "guest": False, "last": last, "doc_id": doc_id, "tie": tie,
                       "text": squeeze(text.encode("utf-8", "surrogatepass"))}
                out.append(row)
                size += len(row["text"])
                if starts[part] == key:
                    out.append({**row, "part": (part - 1) % len(starts), "guest": True})
                if size > _FLUSH:
                    yield pa.RecordBatch.from_pylist(out, schema=_DEALT)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor().decompress
        out, size, held = [], 0, None
        for batch in batches:
            for part, guest, doc_id, packed in columns_of(batch, "part", "guest", "doc_id", "text"):
                text = opened(packed).decode("utf-8", "surrogatepass")
                mine = sketch(text, k, words)
                # A range ends with its guest; of equal guests the first counts.
                if held is not None and held[0] == part:
                    out.append(_row(held[1], held[2], text, k, words, held[3], mine))
                    size += len(text) // 8 + 40 * k
                held = None if guest else (part, doc_id, text, mine)
                if size > _FLUSH:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    dealt = body.mapInArrow(deal, "part bigint, guest boolean, last boolean, doc_id bigint, tie bigint, text binary")
    order = ["part", "guest", "last", "doc_id", "tie"]
    # A range is a task: no two share one by chance.
    return dealt.repartitionById(max(1, len(starts)), F.col("part").cast("int")).sortWithinPartitions(*order).select("part", "guest", "doc_id", "text").mapInArrow(run, _OUT)


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(table(spark, sf_dir, "documents").select("doc_id", "text"))

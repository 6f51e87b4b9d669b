"""Optimal length buckets and token-budget batches.

The histogram of the lengths of all documents goes to the driver (its number
of bins is bounded by the number format, not by the data), dynamic programming
over it chooses the bucket tops that minimise the padding, and each bucket is
cut into batches whose padded size stays within a token budget.

Bins are exact up to 2,048 tokens and have 11 significant bits above; a bin's
top is the longest length in it, so every document fits its bucket.

Defined cases: a null or empty text has length 0 and is packed like any other;
a document longer than the budget is a batch of its own and is not cut;
repeated rows are packed each; an empty table gives no rows; further columns
do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codesift.llm.common import table, word_count
from codesift.session import durable

BUCKETS = 16
BUDGET = 16_384
CHUNK_ROWS = 50_000
_BITS = 11


def length_bin(length: Column) -> Column:
    """Length with its lower bits cleared beyond ``_BITS`` significant ones."""
    width = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)))) - (_BITS - 1), F.lit(0)).cast("int")
    step = F.pow(F.lit(2.0), width).cast("long")
    return length - F.pmod(length, step)


def best_tops(histogram: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Tops of at most ``buckets`` buckets with the least padding.

    ``histogram`` holds (top, count, tokens) in ascending order.  The padding
    of bins i..j in one bucket is ``top_j * count(i..j) - tokens(i..j)``; for a
    fixed number of buckets the best start is the lowest of straight lines at
    ``top_j``, which a hull with ascending queries finds in linear time.
    """
    n = len(histogram)
    if not n:
        return []
    count, tokens = [0], [0]
    for _, c, t in histogram:
        count.append(count[-1] + c)
        tokens.append(tokens[-1] + t)
    tops = [h[0] for h in histogram]
    best = [tops[j] * count[j + 1] - tokens[j + 1] for j in range(n)]
    cuts = [[0] * n]
    for _ in range(1, min(buckets, n)):
        hull, at, new, cut = [], 0, list(best), list(range(n))
        new[0], cut[0] = best[0], 0
        for j in range(1, n):
            # Line of a last bucket that starts at bin j.
            line = (-count[j], best[j - 1] + tokens[j], j)
            while len(hull) > 1 and (
                    (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0])
                    <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0])):
                hull.pop()
            hull.append(line)
            at = min(at, len(hull) - 1)
            value = lambda k: hull[k][0] * tops[j] + hull[k][1]
            while at + 1 < len(hull) and value(at + 1) <= value(at):
                at += 1
            found = value(at) + tops[j] * count[j + 1] - tokens[j + 1]
            new[j], cut[j] = (found, hull[at][2]) if found < best[j] else (best[j], -1)
        best = new
        cuts.append(cut)
    chosen, j, k = [], n - 1, len(cuts) - 1
    while j >= 0:
        while k and cuts[k][j] == -1:
            k -= 1
        chosen.append(tops[j])
        if k == 0:
            break
        j, k = cuts[k][j] - 1, k - 1
    return chosen[::-1]


def packed_batches(
    lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``lengths(doc_id, n_tokens)`` with bucket, batch in the bucket, place in
    the batch and padding."""
    rows = durable(lengths)
    bins = rows.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(
        F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    histogram = sorted((r["top"], r["n"], r["tokens"]) for r in bins.collect())
    tops = best_tops(histogram, buckets)
    most = sum(h[1] for h in histogram)
    limits = F.array(*[F.lit(t).cast("long") for t in tops]) if tops else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(limits, lambda t: t < F.col("n_tokens")))
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_len", F.get(limits, F.col("bucket")))
    # A bucket may hold a third of all rows, so it is numbered in chunks.
    chunks = max(1, -(-most // chunk_rows))
    mix = F.xxhash64(F.lit(5), "doc_id", "n_tokens")
    rows = rows.withColumn("_mix", mix).withColumn("_chunk", F.pmod(mix, F.lit(chunks)))
    counts = rows.groupBy("bucket", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("bucket", "_chunk").orderBy("_mix", "doc_id", "n_tokens")
    rows = rows.withColumn("_row", F.row_number().over(inside) - 1).join(starts, ["bucket", "_chunk"])
    number = F.col("_start") + F.col("_row")
    width = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("long")
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(number / width).alias("batch"),
        F.pmod(number, width).alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed_batches(docs.select("doc_id", word_count().alias("n_tokens")))

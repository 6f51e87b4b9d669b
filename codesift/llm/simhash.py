"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of its shingles' hashes
have it.  To find all pairs of fingerprints within ``radius`` differing bits,
the 64 bits are dealt into parts, correlated bits into the same part, and the
parts get thresholds ``t`` with ``sum(t) = radius - parts + 1``: any such pair
is within ``t`` of each other in at least one part.  Parts with ``t = -1`` are
not probed.  Number of parts and thresholds come from dynamic programming on
estimated candidate counts, measured over all distinct fingerprints.

Each probe puts a fingerprint into a bucket (part, value of the part, or value
with up to ``t`` bits turned).  A bucket links its members by comparing them in
full and returns a spanning forest, never its pairs.  A bucket beyond
``BUCKET_ROWS`` is not compared: its members go to finer buckets by the
pigeonhole principle on the bits that are left, as often as it takes, so large
groups of near copies lose no link and no task holds a whole one.

Equal texts share a fingerprint and are compared once.  Defined cases: a null
or empty text has fingerprint zero and is linked like any other; null ids
never name a component unless all its ids are null; repeated rows are returned
each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codesift.llm.common import packed, table
from codesift.llm.components import components
from codesift.session import durable, durable_counted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 3
WORDS = 3
BUCKET_ROWS = 4096
SMALL_BUCKET = 32
_LANES = np.uint64(0x0101010101010101)


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` lower-cased words; all of them if there are fewer."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    if len(parts) <= words:
        return [b" ".join(parts)]
    return [b" ".join(x) for x in zip(*[parts[i:] for i in range(words)])]


def hashes(text: str | None, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    got = shingles(text, words)
    return np.fromiter((digest(s, 42) for s in got), np.uint64, len(got))


def fingerprint(h: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    if not len(h):
        return 0
    counts = np.zeros((8, 8), np.int64)
    for start in range(0, len(h), 255):
        block = h[start:start + 255]
        for bit in range(8):
            # Eight counters of one byte each are summed in one number.
            lanes = ((block >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64)
            counts[:, bit] += np.frombuffer(lanes.tobytes(), np.uint8)
    set_ = (2 * counts.reshape(64) > len(h)).astype(np.uint8)
    return int(np.packbits(set_, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """``docs`` with the column ``fp``; ``docs`` must not have one."""
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(hashes(t.as_py(), words)) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(fps, pa.int64())], names=[*names, "fp"])

    schema = docs.drop(text).schema.add("fp", "long")
    return docs.mapInArrow(run, schema)


# --- parts and thresholds -----------------------------------------------------


def bit_matrix(reps: DataFrame) -> np.ndarray:
    """How often two bits are set together, over all distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            fps = np.asarray(batch.column("fp"), dtype="<i8")
            for start in range(0, len(fps), 8192):
                bits = np.unpackbits(fps[start:start + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                bits = bits.astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(4096), pa.int32()), pa.array(total.reshape(-1).astype(np.int64))], names=["cell", "n"])

    cells = reps.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(4096)
    for r in cells.collect():  # 64 x 64 cells, whatever the input
        out[r["cell"]] = r["n"]
    return out.reshape(64, 64)


def grouped_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal the bits into parts of nearly equal size, correlated bits together."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        first = max(left, key=lambda b: (max(corr[b, left]), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def within(p: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1, .. bits of a part,
    taking the bits as independent."""
    dist = np.zeros(len(bits) + 1)
    dist[0] = 1
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        dist[1:] = dist[1:] * (1 - differ) + dist[:-1] * differ
        dist[0] *= 1 - differ
    return np.cumsum(dist)[:most + 1]


def _ball(width: int, t: int) -> int:
    return sum(math.comb(width, k) for k in range(t + 1))


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, -1 or more, with the given sum and the least cost.

    ``costs[i][t + 1]`` is the cost of part i with threshold t.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                got = (cost + c, [*chosen, t])
                if used + t not in new or got[0] < new[used + t][0]:
                    new[used + t] = got
        best = new
    return best[total]


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def plan(reps: DataFrame, n: int, radius: int, probe_cost: float = 20.0) -> list[tuple[list[int], int]]:
    """Parts (lists of bits) with their thresholds, the probed ones only.

    The candidate count of a part at threshold 0 is measured: the sum of the
    squared counts of its values over all fingerprints.  Beyond, it grows as
    the chance to differ in at most t bits.  A probe costs as much as
    ``probe_cost`` candidates.
    """
    together = bit_matrix(reps)
    p = np.diag(together) / max(n, 1)
    layouts = {m: grouped_bits(together, n, m) for m in range(2, radius + 2)}
    masks = [(m, i, mask_of(bits)) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    rows = reps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for m, i, x in masks])).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("c"))
    squares = counts.groupBy("k.m", "k.i").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s")).collect()
    measured = {(r["m"], r["i"]): r["s"] for r in squares}
    found = []
    for m, groups in layouts.items():
        total, costs = radius - m + 1, []
        for i, bits in enumerate(groups):
            chance = within(p, bits, total + 1)
            row = [0.0]
            for t in range(len(chance)):
                probes = _ball(len(bits), t)
                row.append(measured.get((m, i), 0.0) * chance[t] / max(chance[0], 1e-30) / 2 + probe_cost * n * probes)
            costs.append(row)
        found.append((*allot(costs, total), groups))
    _, chosen, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, chosen) if t >= 0]


# --- buckets --------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probes(reps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Bucket rows ``mask, value, fp``: the part's value, and the values with up
    to t bits turned that are smaller than it (each pair meets once)."""
    rows = []
    for bits, t in parts:
        mask = F.lit(mask_of(bits))
        own = F.col("fp").bitwiseAND(mask)
        home = reps.select(mask.alias("mask"), own.alias("value"), "fp")
        rows.append(home)
        turns = [_signed(sum(1 << b for b in c)) for k in range(1, t + 1) for c in itertools.combinations(bits, k)]
        if turns:
            turned = reps.select(mask.alias("mask"), own.alias("own"), "fp", F.explode(F.array(*[F.lit(x) for x in turns])).alias("x"))
            turned = turned.select("mask", F.col("own").bitwiseXOR(F.col("x")).alias("value"), "fp", "own")
            rows.append(turned.where("value < own").drop("own"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _splits(mask: int, radius: int) -> bool:
    """Whether the free bits can be dealt; if not, they are so few that a
    bucket holds a fixed number of distinct fingerprints at most."""
    return 64 - (mask & (1 << 64) - 1).bit_count() > radius


def _finer(mask: int, parts: int) -> list[int]:
    """The bits not in the mask, in ``parts`` masks."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in free[i::parts]) for i in range(parts)]


def _boundaries(rows: np.ndarray, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the buckets in sorted rows."""
    differ = np.zeros(max(len(rows) - 1, 0), bool)
    for k in keys:
        differ |= np.diff(rows[k]) != 0
    starts = np.concatenate([[0], np.flatnonzero(differ) + 1])
    return starts, np.diff(np.concatenate([starts, [len(rows)]]))


def _bucket_stream(batches, read, keys, linked, refined, splits, most):
    """Feed whole buckets of sorted rows to ``linked`` and the rows of buckets
    beyond ``most`` to ``refined``.  At most one bucket of ``most`` rows and one
    batch are held."""

    def whole_buckets(rows):
        if not len(rows):
            return
        starts, sizes = _boundaries(rows, keys)
        large = (sizes > most) & np.array([splits(rows[s]) for s in starts])
        for s, n in zip(starts[large], sizes[large]):
            yield refined(rows[s:s + n])
        yield from linked(rows[np.repeat(~large, sizes)])

    held, spill = None, None  # spill: the bucket that goes on to finer ones
    for batch in batches:
        rows = read(batch)
        if spill is not None and len(rows):
            ours = np.ones(len(rows), bool)
            for k, v in zip(keys, spill):
                ours &= rows[k] == v
            if ours.any():
                yield refined(rows[ours])
                rows = rows[~ours]
            if len(rows):
                spill = None
        if held is not None:
            rows = np.concatenate([held, rows])
            held = None
        if not len(rows):
            continue
        # The last bucket may go on in the next batch.
        last = int(_boundaries(rows, keys)[0][-1])
        yield from whole_buckets(rows[:last])
        tail = rows[last:]
        if len(tail) > most and splits(tail[0]):
            yield refined(tail)
            spill = tuple(tail[k][0] for k in keys)
        else:
            held = tail
    if held is not None:
        yield from whole_buckets(held)


def _edges_of(rows, keys, close, forest) -> np.ndarray:
    """Edges between row numbers of linked rows; ``close(i, j)`` compares pairs
    of rows, ``forest(rows)`` links one larger bucket."""
    starts, sizes = _boundaries(rows, keys)
    out = []
    group_end = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat(sizes <= SMALL_BUCKET, sizes))
    for step in range(1, int(min(sizes.max(), SMALL_BUCKET))):
        at = at[at + step < group_end[at]]
        if not len(at):
            break
        near = close(at, at + step)
        out.append(np.stack([at[near], at[near] + step], 1))
    for s, n in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
        out.append(forest(s, n) + s)
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _forest(n: int, near) -> np.ndarray:
    """Links of one bucket as edges to the first member of each component;
    ``near(i, others)`` tells which of the others are linked to row i."""
    label = np.full(n, -1)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        reach = [start]
        while reach:
            open_ = np.flatnonzero(label < 0)
            if not len(open_):
                break
            found = open_[near(reach.pop(), open_)]
            label[found] = start
            reach.extend(found.tolist())
    linked = np.flatnonzero(label != np.arange(n))
    return np.stack([label[linked], linked], 1)


def _link_buckets(radius: int, most: int):
    """Arrow map over rows sorted by bucket: edges, and rows for finer buckets."""
    keys = ("mask", "value")
    dtype = [("mask", "<i8"), ("value", "<i8"), ("fp", "<i8")]

    def out(mask, value, fp, a, b, edge) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(x)) for x in (mask, value, fp, a, b)] + [pa.array(np.full(len(mask), edge))],
            names=["mask", "value", "fp", "a", "b", "edge"])

    def read(batch: pa.RecordBatch) -> np.ndarray:
        rows = np.empty(batch.num_rows, dtype)
        for c in ("mask", "value", "fp"):
            rows[c] = np.asarray(batch.column(c))
        return rows

    def refined(rows: np.ndarray) -> pa.RecordBatch:
        mask, parts = int(rows["mask"][0]) & (1 << 64) - 1, []
        for fine in _finer(mask, radius + 1):
            new = rows["value"].astype("<u8") | (rows["fp"].astype("<u8") & np.uint64(fine))
            parts.append((np.full(len(rows), np.uint64(fine | mask)).view("<i8"), new.view("<i8"), rows["fp"]))
        mask, value, fp = (np.concatenate(x) for x in zip(*parts))
        none = np.zeros(len(mask), np.int64)
        return out(mask, value, fp, none, none, False)

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        fps = np.ascontiguousarray(rows["fp"]).view("<u8")
        close = lambda i, j: np.bitwise_count(fps[i] ^ fps[j]) <= radius
        forest = lambda s, n: _forest(n, lambda i, others: np.bitwise_count(fps[s + others] ^ fps[s + i]) <= radius)
        pairs = np.ascontiguousarray(rows["fp"])[_edges_of(rows, keys, close, forest)]
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        if len(pairs):
            none = np.zeros(len(pairs), np.int64)
            yield out(none, none, none, pairs[:, 0], pairs[:, 1], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _bucket_stream(batches, read, keys, linked, refined, lambda row: _splits(int(row["mask"]), radius), most)

    return run


def links(reps: DataFrame, n: int, radius: int = RADIUS, most: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs within ``radius``."""
    schema = "mask bigint, value bigint, fp bigint, a bigint, b bigint, edge boolean"
    todo, edges = probes(reps, plan(reps, n, radius)), None
    while True:
        dealt = todo.repartition("mask", "value").sortWithinPartitions("mask", "value")
        out = durable(dealt.mapInArrow(_link_buckets(radius, most), schema))
        found = out.where("edge").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        todo, open_ = durable_counted(out.where("NOT edge").select("mask", "value", "fp"))
        if not open_:
            return edges
        # A finer bucket may hold the same fingerprint twice by different ways.
        todo = todo.distinct()


def labelled(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows(doc_id, fp, ...)`` with ``component_id``, the smallest doc_id
    that links of at most ``radius`` bits reach."""
    reps, n = durable_counted(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return named(rows, reps, components(links(reps, n, radius)))


def named(rows: DataFrame, reps: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows(fp, ...)`` with the smallest doc_id of their component."""
    known = reps.join(roots, reps["fp"] == roots["v"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Written by itself, so that the join below can split a large component.
    names = durable(known.groupBy("root").agg(F.min("first").alias("component_id")))
    return rows.join(known.join(names, "root").select("fp", "component_id"), "fp")


def hex16(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest doc_id,
    with its columns; rows that repeat it stay once."""
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    keys = durable(fingerprints(rows.select("doc_id", "text"), words))
    kept = labelled(keys, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return staying(rows, keys, kept)


def staying(rows: DataFrame, keys: DataFrame, kept: DataFrame) -> DataFrame:
    """Packed ``rows`` whose doc_id is kept, each once."""
    left = rows.alias("r").join(kept.alias("k"), F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
    repeated = keys.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").alias("k")
    same = F.col("r.doc_id").eqNullSafe(F.col("k.doc_id"))
    once = left.join(repeated, same, "left_anti")
    again = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).select("row.*")


def op3_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = durable(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    return labelled(rows).select("doc_id", hex16().alias("fingerprint"), "component_id")

"""A trigram index of a corpus, for searches that are asked again and again.

A regex implies which runs of three characters a matching text must hold, as a
condition of ANDs and ORs.  The index answers it from postings alone; only the
candidates' texts are read, and the regex itself decides on them, so the rows are
those of a full scan.  A regex that implies nothing scans all texts.

``write_index`` lays down four tables below a folder:

* ``texts``, the files, in folders of blocks of about ``BLOCK_BYTES``; a search
  reads the blocks of its candidates and no others,
* ``sizes(file_id, block, size)``, so that what a search reads is known without
  opening the blocks,
* ``postings(gram, block, files)``, ordered by trigram, so that a lookup skips the
  row groups of other trigrams.  A frequent trigram has a row per block and
  batch, never one array over the corpus,
* ``grams(gram, n)``, the files that hold a trigram: a search asks for the rarest
  trigrams of each AND and leaves out the rest.

Trigrams are taken of folded text (one case), which finds a superset for patterns
that distinguish case.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from re import _constants as sre, _parser as parser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codesift.operators.match import Rule, find_matches
from codesift.session import durable

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 64 << 20
# Alternatives that are followed as exact strings, and trigrams of one AND that
# are looked up.
MOST_STRINGS = 32
RAREST = 4
# Bits of one column of a file's found trigrams.
_BITS = 62


def fold(text: str) -> str:
    """One case: what an engine may take for the same letter is the same here."""
    return text.replace("İ", "i").upper().lower().replace("ς", "σ")


def gram_of(three: str) -> int:
    a, b, c = map(ord, three)
    return a << 42 | b << 21 | c


def grams_of(text: str) -> np.ndarray:
    """Distinct trigrams of a text as numbers, ascending."""
    points = np.frombuffer(fold(text).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]) if len(points) > 2 else np.empty(0, np.int64)


# --- what a regex implies ------------------------------------------------------
#
# A condition is True (nothing implied), a trigram, ("and", parts) or ("or", parts).

Condition = bool | str | tuple


def _all(parts: Sequence[Condition]) -> Condition:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: Sequence[Condition]) -> Condition:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


class _Walk:
    """Goes along a parsed regex with the strings the text may hold since the
    last place it cannot tell."""

    def __init__(self) -> None:
        self.found: list[Condition] = []
        self.strings = {""}

    def stop(self) -> None:
        strings, self.strings = self.strings, {""}
        self.found.append(_any([_all([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]))

    def append(self, choices: set[str]) -> None:
        if len(self.strings) * len(choices) > MOST_STRINGS:
            self.stop()
        if len(choices) > MOST_STRINGS:
            return
        self.strings = {s + c for s in self.strings for c in choices}

    def walk(self, nodes, ignore_case: bool) -> None:
        for op, value in nodes:
            if op is sre.LITERAL:
                char = chr(value)
                if ignore_case and not char.isascii():
                    self.stop()
                else:
                    self.append({fold(char)})
            elif op is sre.IN:
                chars = _few(value, ignore_case)
                self.append(chars) if chars else self.stop()
            elif op is sre.SUBPATTERN:
                _group, on, off, inner = value
                self.walk(inner, (ignore_case or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
            elif op is sre.ATOMIC_GROUP:
                self.walk(value, ignore_case)
            elif op is sre.BRANCH:
                ways = []
                for way in value[1]:
                    w = _Walk()
                    w.walk(way, ignore_case)
                    ways.append(w)
                if all(not w.found for w in ways):
                    self.append(set().union(*(w.strings for w in ways)))
                else:
                    self.stop()
                    self.found.append(_any([w.condition() for w in ways]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                least, most, inner = value
                if least == 0:
                    self.stop()
                    continue
                if most == least and least <= MOST_STRINGS:
                    for _ in range(least):
                        self.walk(inner, ignore_case)
                    continue
                self.walk(inner, ignore_case)
                if most > 1:
                    self.stop()
                    last = _Walk()
                    last.walk(inner, ignore_case)
                    # What follows stands beside the last of the repeats.
                    self.strings = last.strings
            elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                continue  # of no width
            else:
                self.stop()

    def condition(self) -> Condition:
        self.stop()
        return _all(self.found)


def _few(members, ignore_case: bool) -> set[str]:
    """The characters of a small class; empty when it is large or negated."""
    out: set[str] = set()
    for op, value in members:
        if op is sre.LITERAL:
            span = range(value, value + 1)
        elif op is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
            span = range(value[0], value[1] + 1)
        else:
            return set()
        out |= {fold(chr(c)) for c in span}
        if ignore_case and any(c > 127 for c in span):
            return set()
    return out if len(out) <= MOST_STRINGS else set()


def condition_of(pattern: str) -> Condition:
    """The trigrams any match of ``pattern`` implies; True where it cannot be
    told, as for forms that only one of the two regex languages knows."""
    # Nested classes, their intersections and quotes read differently there.
    if re.search(r"\[[^\]]*(\[|&&)|\\[QE]", pattern):
        return True
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return True
    walk = _Walk()
    walk.walk(tree, bool(tree.state.flags & re.IGNORECASE))
    return walk.condition()


def grams_in(condition: Condition) -> set[str]:
    if condition is True:
        return set()
    return {condition} if isinstance(condition, str) else set().union(*map(grams_in, condition[1]))


def rarest(condition: Condition, counts: dict[str, int]) -> Condition:
    """The condition with no more than the ``RAREST`` plain trigrams of each AND."""
    if condition is True or isinstance(condition, str):
        return condition
    kind, parts = condition
    if kind == "or":
        return _any([rarest(p, counts) for p in parts])
    plain = sorted((p for p in parts if isinstance(p, str)), key=lambda g: (counts.get(g, 0), g))[:RAREST]
    return _all([*plain, *[rarest(p, counts) for p in parts if not isinstance(p, str)]])


# --- the tables ------------------------------------------------------------------


@dataclass
class Index:
    """A written index; its folders, one a block, are listed once."""

    spark: SparkSession
    folder: str

    @cached_property
    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/texts")

    @cached_property
    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/sizes")

    @cached_property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    @cached_property
    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/grams")


_POSTINGS = "gram bigint, block int, files array<bigint>"


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per trigram and block of a batch, with the files that hold it."""
    for batch in batches:
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        ids = batch.column("file_id").to_numpy(zero_copy_only=False)
        parts = [grams_of(t.as_py() or "") for t in batch.column("text")]
        if not parts:
            continue
        size = [len(p) for p in parts]
        gram, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
        order = np.lexsort((ids[row], blocks[row], gram))
        gram, block, file_id = gram[order], blocks[row][order], ids[row][order]
        first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])))) if len(gram) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), pa.array(file_id, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram[first], pa.int64()), pa.array(block[first], pa.int32()), lists], ["gram", "block", "files"])


def write_index(files: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> Index:
    """Index ``files(file_id, path, size, text)`` below ``folder``."""
    spark = files.sparkSession
    total = files.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = files.select("file_id", "path", "size", "text", F.pmod(F.xxhash64("file_id", "path"), F.lit(blocks)).cast("int").alias("block"))
    rows.repartition("block").sortWithinPartitions("block", "file_id").write.partitionBy("block").parquet(f"{folder}/texts")
    texts = spark.read.schema(rows.schema).parquet(f"{folder}/texts")
    held = durable(texts.select("file_id", "block", "text").mapInArrow(_post, _POSTINGS))
    held.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{folder}/postings")
    texts.select("file_id", "block", "size").write.parquet(f"{folder}/sizes")
    index = Index(spark, folder)
    index.texts = texts
    index.postings.groupBy("gram").agg(F.sum(F.size("files")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")
    return index


def _holds(condition: Condition, place: dict[str, int]) -> Column:
    if isinstance(condition, str):
        word, bit = divmod(place[condition], _BITS)
        return F.col(f"w{word}").bitwiseAND(F.lit(1 << bit)) != 0
    out = None
    for part in condition[1]:
        test = _holds(part, place)
        out = test if out is None else (out & test if condition[0] == "and" else out | test)
    return out


def candidates(index: Index, condition: Condition) -> DataFrame:
    """``file_id, block`` of the files that hold what a condition asks for."""
    names = sorted(grams_in(condition))
    # As many rows as the pattern has trigrams.
    known = {r["gram"]: r["n"] for r in index.grams.where(F.col("gram").isin([gram_of(g) for g in names])).collect()}
    condition = rarest(condition, {g: known.get(gram_of(g), 0) for g in names})
    place = {g: i for i, g in enumerate(sorted(grams_in(condition)))}
    numbers = F.create_map(*[F.lit(x) for g, i in place.items() for x in (gram_of(g), i)])
    rows = index.postings.where(F.col("gram").isin([gram_of(g) for g in place]))
    rows = rows.select("block", F.explode("files").alias("file_id"), F.element_at(numbers, F.col("gram")).alias("i"))
    words = []
    for w in range(-(-len(place) // _BITS)):
        inside = (F.col("i") >= w * _BITS) & (F.col("i") < (w + 1) * _BITS)
        bit = F.expr(f"shiftleft(1L, CAST(i - {w * _BITS} AS INT))")
        words.append(F.bit_or(F.when(inside, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}"))
    return rows.groupBy("file_id", "block").agg(*words).where(_holds(condition, place)).select("file_id", "block")


def candidate_files(index: Index, patterns: Sequence[str]) -> DataFrame:
    """Files that a search for any of ``patterns`` tests, read from the blocks
    that have a candidate; all files where a pattern implies nothing."""
    condition = _any([condition_of(p) for p in patterns])
    if condition is True:
        return index.texts
    found = durable(candidates(index, condition))
    # At most as many numbers as there are blocks.
    blocks = sorted(r["block"] for r in found.select("block").distinct().collect())
    return index.texts.where(F.col("block").isin(blocks)).join(found.drop("block"), "file_id", "left_semi")


def indexed_matches(index: Index, rules: Sequence[Rule], group: Callable[[], Column] | None = None, **options) -> DataFrame:
    """As ``find_matches`` over all files: the rules that imply trigrams on the
    candidates of any of them, read once, and the others on everything."""
    known = [r for r in rules if condition_of(r.regex) is not True]
    parts = []
    for some, files in ((known, lambda: candidate_files(index, [r.regex for r in known])), ([r for r in rules if r not in known], lambda: index.texts)):
        if some:
            parts.append(find_matches(files(), some, group() if group else None, **options))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def search_cost(index: Index, pattern: str) -> DataFrame:
    """What a search reads, beside the whole corpus: one row."""
    everything = index.sizes.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    condition = condition_of(pattern)
    read = index.sizes
    if condition is not True:
        # The files that ``candidate_files`` would read.
        found = durable(candidates(index, condition))
        read = read.join(found.select("block").distinct(), "block", "left_semi").join(found.select("file_id"), "file_id", "left_semi")
    read = read.agg(F.count("*").alias("candidates"), F.coalesce(F.sum("size"), F.lit(0)).alias("candidate_bytes"))
    both = everything.withColumn("_one", F.lit(1)).join(read.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.select(F.lit(pattern).alias("pattern"), F.lit(condition is not True).alias("indexed"), "*")

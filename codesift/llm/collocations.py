"""Phrase collocations from counts of contiguous phrases, by sorting suffixes.

Every word of a text starts a suffix of at most ``LONGEST`` words, cut at the end
of its piece.  The suffixes are routed by their leading words: ranges of their
order, chosen so that each holds about ``RANGE`` of them, go to one task each.
There, suffix pointers are sorted by multikey quicksort: the pointers of a
partition are split three ways by one word, those that are equal are counted and
go on to the next word, and a partition with fewer than ``least`` occurrences is
abandoned, since no phrase in it can be frequent.  All open partitions take a
step at a time, in numpy.

What keeps it whole and even:

* A first pass counts all words per language and takes suffixes at a fixed
  stride for the ends of the ranges, as Spark's own range partitioning does;
  they decide who works on what, never what is counted.
* Equal suffixes of a buffer of texts are one line with a count before the
  shuffle, so a passage with thousands of copies is light; a frequent leading
  word is split at its second, third or fourth word.
* The lines of a range travel compressed and a task turns each buffer's lines
  into word numbers as they come, so it never holds the text of its range.
* A phrase that an end of a range begins with can lie on both sides of it; such
  phrases (at most six a range) are counted apart and added up, all others are
  complete in their range.

Scores, cuts and containment are joins of the table of frequent phrases with
itself; arithmetic is decimal, so products may pass 64 bits.

Defined cases: a null or empty text has no words; a null language is ``und``;
equal scores are ordered by count and then phrase, equal cuts by the shorter
first part; repeated rows count each; an empty table gives no rows; further
columns do not matter.  A very long text is one buffer, in memory of about ten
times its bytes.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codesift.llm.common import columns_of, table, text_or_empty
from codesift.operators.ordering import numbered
from codesift.session import durable

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 30
LONGEST = 4
TOP = 2000
CONTAINED = 80  # per cent
SCALE = 2_000_000
# Bytes of text of one buffer, suffixes of one range, ends taken of each range.
BUFFER = 8 << 20
RANGE = 1_000_000
ENDS = 40
# Suffixes whose lines are spelt out at a time.
SPELT = 100_000

# Byte classes: white space inside a piece, ends of a piece, the rest is words.
_BLANKS = b"\x20\x09"
_STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_BLANKS)] = 1
_CLASS[list(_STOPS)] = 2


def _coded(strings: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The sorted distinct ``strings``, and the number of each among them."""
    coded = strings.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()] if len(strings) else np.empty(0, np.int32)


class Words:
    """The words of some bytes: numbers into their sorted vocabulary, and for
    each the number of words from it to the end of its piece."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        kind = _CLASS[raw]
        word = kind == 0
        edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        n = len(starts)
        plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
        self.vocabulary, self.ids = _coded(plain)
        # Stops before a word number its piece; the numbers ascend.
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.left = np.searchsorted(piece, piece, "right") - np.arange(n)

    def suffixes(self, at: np.ndarray) -> np.ndarray:
        """Rows of ``LONGEST`` word numbers from the places ``at`` on; -1
        beyond the end of the piece."""
        out = np.full((len(at), LONGEST), -1, np.int32)
        for k in range(LONGEST):
            has = self.left[at] > k
            out[has, k] = self.ids[at[has] + k]
        return out


def _runs(rows: np.ndarray) -> np.ndarray:
    """Where the sorted ``rows`` begin to differ from the row before."""
    return np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))) if len(rows) else np.empty(0, np.int64)


def distinct_suffixes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of two words and more in their order, and how often each occurs."""
    rows = words.suffixes(np.flatnonzero(words.left > 1))
    rows = rows[np.lexsort(rows.T[::-1])]
    first = _runs(rows)
    return rows[first], np.diff(np.append(first, len(rows)))


def three_way(rows: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Phrases that occur at least ``least`` times: for each length from two
    words on, one suffix that begins with each phrase, and its occurrences.

    Multikey quicksort of pointers to ``rows``, all open partitions a step at a
    time: partition ``p`` looks at word ``depth[p]`` of its pointers.
    """
    found = [[] for _ in range(LONGEST + 1)]
    pointers = np.arange(len(rows))
    part, depth = np.zeros(len(rows), np.int64), np.zeros(1, np.int64)
    while len(pointers):
        word = rows[pointers, depth[part]]
        size = np.bincount(part, minlength=len(depth))
        middle = np.cumsum(size) - (size + 1) // 2
        pivot = word[middle]
        side = np.sign(word - pivot[part]) + 1  # 0 less, 1 equal, 2 greater
        label = 3 * part + side
        order = np.argsort(label, kind="stable")
        pointers, label = pointers[order], label[order]
        weight = np.bincount(label, weights=counts[pointers], minlength=3 * len(depth)).astype(np.int64)
        deeper = depth.repeat(3) + np.tile([0, 1, 0], len(depth))
        # Beyond the end of a suffix there is nothing: its word is -1.
        ended = np.zeros(3 * len(depth), bool)
        ended[1::3] = pivot < 0
        alive = (weight >= least) & ~ended
        for d in range(2, LONGEST + 1):
            hit = np.flatnonzero(alive[1::3] & (deeper[1::3] == d)) * 3 + 1
            if len(hit):
                found[d].append((pointers[np.searchsorted(label, hit)], weight[hit]))
        alive &= deeper < LONGEST
        keep = alive[label]
        number = np.cumsum(alive) - 1
        pointers, part, depth = pointers[keep], number[label[keep]], deeper[alive]
    return [(np.concatenate([p for p, _ in f]), np.concatenate([w for _, w in f])) if f else (np.empty(0, np.int64), np.empty(0, np.int64))
            for f in found]


def _phrases(vocabulary: pa.Array, rows: np.ndarray, length: int) -> pa.Array:
    """Space-joined first ``length`` words of suffixes."""
    columns = [vocabulary.take(pa.array(rows[:, k])) for k in range(length)]
    return pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))


def _buffers(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """Texts of a language joined to about ``size`` bytes; line ends between
    them, since no phrase crosses texts."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in columns_of(batch, "lang", "text"):
            data = text.encode().lower()  # lower-cases A-Z only
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            if sizes[lang] >= size:
                yield lang, b"\n".join(held.pop(lang))
                del sizes[lang]
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))


_SEEN = "lang string, word binary, n bigint, suffix array<binary>"


def _first_pass(docs: DataFrame, stride: int) -> DataFrame:
    """Counts of all words, and every ``stride``-th suffix (``word`` null)."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("suffix", pa.list_(pa.binary()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _buffers(batches, BUFFER):
            words = Words(data)
            n = len(words.vocabulary)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), words.vocabulary.cast(pa.binary()),
                 pa.array(np.bincount(words.ids, minlength=n), pa.int64()), pa.nulls(n, schema.field("suffix").type)], schema=schema)
            at = np.flatnonzero(words.left > 1)[stride // 2::stride]
            vocabulary = words.vocabulary
            taken = [[vocabulary[i].as_py() for i in row if i >= 0] for row in words.suffixes(at).tolist()]
            yield pa.RecordBatch.from_pylist([{"lang": lang, "suffix": s} for s in taken], schema=schema)

    return _texts(docs).mapInArrow(count, _SEEN)


def _ranks(vocabulary: pa.Array, words: list[bytes]) -> list[tuple[int, bool]]:
    """Place of each word in the sorted vocabulary, and whether it is there."""
    class Sorted:
        def __len__(self):
            return len(vocabulary)

        def __getitem__(self, i):
            return vocabulary[i].as_py()

    seen, out = Sorted(), []
    for w in words:
        at = bisect_left(seen, w)
        out.append((at, at < len(seen) and seen[at] == w))
    return out


def _below(words: Words, rows: np.ndarray, ends: list[tuple[bytes, ...]]) -> np.ndarray:
    """Number of the sorted suffixes ``rows`` that come before each end."""
    places = dict(zip(w := sorted({x for e in ends for x in e}), _ranks(words.vocabulary, w)))
    columns, out = [rows[:, k] for k in range(LONGEST)], []
    for end in ends:
        lo, hi = 0, len(rows)
        for k, x in enumerate(end):
            rank, there = places[x]
            column = columns[k][lo:hi]
            if not there:
                hi = lo = lo + int(np.searchsorted(column, rank, "left"))
                break
            lo, hi = lo + int(np.searchsorted(column, rank, "left")), lo + int(np.searchsorted(column, rank, "right"))
        out.append(lo)
    return np.array(out, np.int64)


_ROUTED = "part int, lang string, size int, lines binary, counts binary"
_COUNTED = "lang string, phrase binary, n_words int, n bigint, whole boolean"


def _lines(shown: pa.Array, rows: np.ndarray) -> pa.Buffer:
    """Suffixes as lines of text; ``shown`` has the words behind an empty one."""
    columns = [shown.take(pa.array(rows[:, k] + 1)) for k in range(LONGEST)]
    lines = pc.binary_join_element_wise(*columns, pa.array([b"\n"] * len(rows), pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    offsets = np.frombuffer(lines.buffers()[1], np.int64, len(rows) + 1, 8 * lines.offset)
    return lines.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def _read(lines: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of some lines, and the suffix that each line is."""
    words = Words(lines)
    # Each line is a piece, and begins with a suffix.
    return words.vocabulary, words.suffixes(np.flatnonzero(np.concatenate(([True], words.left[:-1] == 1))))


def _united(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Suffixes of several vocabularies in one; ``parts`` is used up."""
    vocabulary, ids = _coded(pa.concat_arrays([v for v, _ in parts]))
    out = np.empty((sum(len(r) for _, r in parts), LONGEST), np.int32)
    end, at = len(ids), len(out)
    while parts:
        own, rows = parts.pop()
        # Beyond the end of a piece there is no word: -1 takes the last number.
        number = np.append(ids[end - len(own):end], np.int32(-1))
        out[at - len(rows):at] = number[rows]
        end, at = end - len(own), at - len(rows)
    return vocabulary, out


def _route(docs: DataFrame, ends: list[tuple]) -> DataFrame:
    """Distinct suffixes of each buffer as lines of text, per range."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("size", pa.int32()), ("lines", pa.binary()), ("counts", pa.binary())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _buffers(batches, BUFFER):
            words = Words(data)
            rows, counts = distinct_suffixes(words)
            # A range is all that lies between two ends (language and suffix).
            low = bisect_left(ends, (lang,))
            here = [e[1:] for e in ends[low:] if e[0] == lang]
            cuts = np.concatenate(([0], _below(words, rows, here), [len(rows)]))
            shown = pa.concat_arrays([pa.array([b""], pa.large_binary()), words.vocabulary])
            del words
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                for i in range(a, b, SPELT):
                    j = min(i + SPELT, b)
                    text = _lines(shown, rows[i:j])
                    yield pa.RecordBatch.from_pylist([{
                        "part": low + k, "lang": lang, "size": len(text), "lines": pa.compress(text, "zstd", asbytes=True),
                        "counts": counts[i:j].astype("<u4").tobytes()}], schema=schema)

    return _texts(docs).mapInArrow(route, _ROUTED)


def _border(lang: str, part: int, ends: list[tuple]) -> set[tuple[bytes, ...]]:
    """Beginnings, of two words and more, of the ends of a range: phrases that
    other ranges may hold too."""
    out = set()
    for at in (part - 1, part):
        if 0 <= at < len(ends) and ends[at][0] == lang:
            out |= {ends[at][1:k + 1] for k in range(2, len(ends[at]))}
    return out


def _counted(routed: DataFrame, ends: list[tuple], least: int) -> DataFrame:
    """Frequent phrases of each range, and the occurrences of those at its ends."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n_words", pa.int32()), ("n", pa.int64()), ("whole", pa.bool_())])

    def batch_of(lang: str, phrases, length: int, n, whole: bool) -> pa.RecordBatch:
        k = len(phrases)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * k, pa.string()), phrases.cast(pa.binary()), pa.array([length] * k, pa.int32()),
             pa.array(n, pa.int64()), pa.array([whole] * k, pa.bool_())], schema=schema)

    def finish(part: int, lang: str, vocabulary: pa.Array, rows: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        border = _border(lang, part, ends)
        for phrase in sorted(border):
            ranks = _ranks(vocabulary, list(phrase))
            if all(there for _, there in ranks):
                n = int(number[(rows[:, :len(phrase)] == [r for r, _ in ranks]).all(axis=1)].sum())
                if n:
                    yield batch_of(lang, pa.array([b" ".join(phrase)], pa.large_binary()), len(phrase), [n], False)
        for length, (at, n) in enumerate(three_way(rows, number, least)):
            if len(at):
                phrases = _phrases(vocabulary, rows[at], length)
                inner = np.array([tuple(p.split(b" ")) not in border for p in phrases.to_pylist()])
                yield batch_of(lang, phrases.filter(pa.array(inner)), length, n[inner], True)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], tuple[list, list]] = {}
        for batch in batches:
            for part, lang, size, lines, counts in columns_of(batch, "part", "lang", "size", "lines", "counts"):
                kept = held.setdefault((part, lang), ([], []))
                kept[0].append(_read(pa.decompress(lines, size, "zstd", asbytes=True)))
                kept[1].append(np.frombuffer(counts, "<u4"))
        while held:
            (part, lang), (parts, counts) = held.popitem()
            yield from finish(part, lang, *_united(parts), np.concatenate(counts).astype(np.int64))

    return routed.mapInArrow(sort, _COUNTED)


def phrase_counts(docs: DataFrame, least: int = LEAST, per_range: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n_words, f`` of all phrases of up to ``LONGEST`` words
    with at least ``least`` occurrences, and ``lang, n``, all words of each."""
    stride = max(1, per_range // ENDS)
    seen = durable(_first_pass(docs, stride).groupBy("lang", "word", "suffix").agg(F.sum("n").alias("f")))
    words = seen.where("word IS NOT NULL")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    # Every ENDS-th of the suffixes taken ends a range: there are as many as ranges.
    taken = numbered(seen.where("word IS NULL").select("lang", "suffix"), [F.col("lang"), F.col("suffix")])
    taken = taken.where(F.pmod("row_no", F.lit(ENDS)) == 0).collect()
    ends = sorted({(r["lang"], *map(bytes, r["suffix"])) for r in taken})
    routed = _route(docs, ends).repartitionById(len(ends) + 1, "part")
    counted = durable(_counted(routed, ends, least))
    both = counted.where("NOT whole").groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    counts = counted.where("whole").select("lang", "phrase", "n_words", F.col("n").alias("f")).unionByName(both).unionByName(
        words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), "f"))
    return counts.withColumn("phrase", F.col("phrase").cast("string")), totals


def scored(counts: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """Candidates with their worst cut: ``lang, phrase, a, l, r, score``."""
    counts = durable(counts)
    phrases = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    part = lambda a, n: F.concat_ws(" ", F.slice("w", a, n))
    cuts = phrases.select("lang", "phrase", "w", "n_words", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    known = counts.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c"))
    # The most frequent longer candidate around each candidate.
    shorter = phrases.where("n_words > 2").select(
        "lang", F.col("a").alias("longer"), "w", "n_words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m"))
    shorter = shorter.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)).alias("i"))
    around = shorter.select("lang", "longer", part(F.col("i"), F.col("m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    rows = worst.select("lang", "phrase", "c.a", "c.l", "c.r", "c.score").join(around, ["lang", "phrase"], "left")
    inside = F.expr(f"CAST(100 AS DECIMAL(8,0)) * CAST(longer AS DECIMAL(19,0)) >= CAST({contained} AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0))")
    return rows.where(~F.coalesce(inside, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, per_range: int = RANGE) -> DataFrame:
    """The ``top`` phrases of each language by score."""
    counts, totals = phrase_counts(docs, least, per_range)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = scored(counts).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM words, unnest(range(1, 5)) AS a(m), unnest(range(1, len(w) - m + 2)) AS b(i)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a // (h.f + t.f))::BIGINT AS score
  FROM candidates c, unnest(range(1, c.m)) AS x(k)
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, unnest(range(2, m)) AS x(s), unnest(range(1, m - s + 2)) AS y(i) GROUP BY ALL),
ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM worst w LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

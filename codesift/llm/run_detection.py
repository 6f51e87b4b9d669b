"""Periodic runs of words by recursive frequency splitting, and texts without them.

A run is a maximal stretch of words with smallest period q and a length of at
least ``max(LEAST_WORDS, LEAST_PERIODS * q)``: each of its words occurs at
least ``LEAST_PERIODS`` times inside it.  So a word that occurs less often in a
segment of the text is in no run of that segment and splits it; the parts are
counted and split again until nothing changes.  Only the segments that are left
are scanned lag by lag.  All of this is per document, in one Arrow map: nothing
is shuffled, and a lost task is done again alone.

Both steps stay near linear on any text.  A split counts all parts but the
largest and subtracts them from the whole, so a word is counted a logarithmic
number of times.  A lag q looks at every q-th word: a stretch of four periods
holds four of them in a row, equal to each other.  Where these lie in a run of
a smaller period, they belong to nothing else (a stretch that shares three
periods with it lies wholly inside), so a run of one word is not found again at
every multiple of its period.

Defined cases: a null or empty text has no words, no runs and an empty collapsed
text; of overlapping runs each is reported, and a word goes when any of them
repeats it; rows that repeat are treated alike, each on its own; an empty table
gives no rows; further columns do not matter.  A very long text is one row in
one task, in memory of about 150 bytes a word.
"""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codesift.llm.common import WORD, columns_of, table, text_or_empty

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_WORDS = 6
LEAST_PERIODS = 4

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def segments(ids: list[int]) -> list[tuple[int, int]]:
    """Stretches in which every word occurs at least ``LEAST_PERIODS`` times."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(ids):
        places.setdefault(w, []).append(i)
    counts = {w: len(p) for w, p in places.items()}
    out, todo = [], [(0, len(ids), counts, [w for w, n in counts.items() if n < LEAST_PERIODS])]
    while todo:
        lo, hi, counts, rare = todo.pop()
        if hi - lo < LEAST_WORDS:
            continue
        if not rare:
            out.append((lo, hi))
            continue
        cuts = []
        for w in rare:
            at = bisect_left(places[w], lo)
            cuts += places[w][at:at + counts.pop(w)]
        cuts.sort()
        parts = [(a + 1, b) for a, b in zip([lo - 1, *cuts], [*cuts, hi]) if b > a + 1]
        if not parts:
            continue
        most = max(parts, key=lambda p: p[1] - p[0])
        if most[1] - most[0] < LEAST_WORDS:
            continue
        fewer = set()
        for a, b in parts:
            if (a, b) == most:
                continue
            inside = Counter(ids[a:b])
            for w, n in inside.items():
                counts[w] -= n
                if counts[w] < LEAST_PERIODS:
                    fewer.add(w)
            if b - a >= LEAST_WORDS:
                todo.append((a, b, inside, [w for w, n in inside.items() if n < LEAST_PERIODS]))
        for w in [w for w in fewer if not counts[w]]:
            fewer.discard(w)
            del counts[w]
        todo.append((*most, counts, list(fewer)))
    return sorted(out)


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal leading elements."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        top = min(at + step, n)
        differ = a[at:top] != b[at:top]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = top, step * 2
    return n


def lag_scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of one segment."""
    n, out = len(w), []
    inside = np.zeros(n, np.int64)  # end of the longest run so far around each word
    for q in range(1, n // LEAST_PERIODS + 1):
        every = w[::q]
        same = every[1:] == every[:-1]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if not len(hits):
            continue
        hits = hits * q
        done = 0
        for x in hits[inside[hits] <= hits + 3 * q].tolist():
            if x < done:
                continue
            # Where the words at this lag stay equal, from x to both sides.
            right = x + _equal_ahead(w[x:], w[x + q:])
            left = x - _equal_ahead(w[:x][::-1], w[q:x + q][::-1])
            done = right + 1
            length = right + q - left
            # Equal at every q-th word, but not in between: no stretch of four.
            if x + 3 * q >= left + length:
                continue
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                out.append((left, length, q))
                np.maximum(inside[left:left + length], left + length, out=inside[left:left + length])
    return out


def periodic_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a text, by start, then period."""
    numbers: dict[str, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    runs = []
    for lo, hi in segments(ids):
        runs += [(lo + s, n, q) for s, n, q in lag_scan(np.array(ids[lo:hi], np.int32))]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def collapsed_runs(
    docs: DataFrame, text: str = "text", edit: Callable[[list[str], object], list[str]] | None = None, key: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the columns ``keep``, by default all), ``runs``, an array of
    (start, length, period), and ``collapsed``, the words of the text without
    their repeats.

    ``edit(words, key)`` may change the words of a document first.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in (docs.columns if keep is None else keep)]).alias("row")
    rows = docs.select(row, text_or_empty(f"`{text}`").alias("_text"), docs[f"`{key}`"].alias("_key"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([rows.schema["row"], T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(WORD).findall
        for batch in batches:
            runs, texts = [], []
            for whole, k in columns_of(batch, "_text", "_key"):
                words = split(whole)
                if edit is not None:
                    words = edit(words, k)
                found = periodic_runs(words)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(" ".join(without_repeats(words, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())], ["row", "runs", "collapsed"])

    return rows.mapInArrow(scan, schema)


def repeated_tail(words: list[str], doc_id: int | None) -> list[str]:
    """Every tenth text, by the checksum of its id, ends in repeats of a stretch
    of its own; a text without an id stays as it is."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * (-(-(n - a) // len(tail))))[:n - a]


def op11_frequency_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapsed_runs(table(spark, sf_dir, "documents"), edit=repeated_tail, keep=["doc_id"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    # Greatest length, then smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = rows.select(
        F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# The same rows by other means: stretches of equal words at each lag that has
# four equal words in a row, without those inside a stretch of a smaller lag.
OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
crc AS (
  SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT) AS h FROM docs),
shape AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS k FROM crc),
edited AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) END AS w FROM shape),
lags AS (SELECT r, n, w, q FROM edited, unnest(range(1, n // 4 + 1)) AS t(q)),
open AS (
  SELECT r, n, w, q FROM lags
  WHERE len(list_filter(range(0, n - 3 * q, q), lambda i: w[i + 1] = w[i + q + 1] AND w[i + 1] = w[i + 2 * q + 1] AND w[i + 1] = w[i + 3 * q + 1])) > 0),
equal AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island
  FROM (SELECT r, q, w, n, unnest(range(0, n - q)) AS i FROM open) WHERE w[i + 1] = w[i + q + 1]),
stretch AS (
  SELECT r, q, min(i) AS s, count(*) + q AS len FROM equal GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretch x WHERE NOT EXISTS (
    SELECT 1 FROM stretch y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
per AS (
  SELECT r, count(*) AS n_runs, arg_min(s, (-len, s, q)) AS start, arg_min(len, (-len, s, q)) AS length, arg_min(q, (-len, s, q)) AS period,
    string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
lost AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(
    list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM edited LEFT JOIN per USING (r) LEFT JOIN lost USING (r)
"""

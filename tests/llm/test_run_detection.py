"""Runs against their definition, the query against SQL."""

import random
import time

import oracle
from conftest import SF

from codesift.llm import run_detection as rd


def brute(words):
    """Maximal stretches at each lag whose smallest period is that lag."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i:i + length]
            smaller = any(part[k:] == part[:-k] for k in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_the_definition():
    rng = random.Random(11)
    for _ in range(3000):
        words = []
        for _ in range(rng.randrange(0, 7)):
            block = [rng.choice("abcdefghij"[:rng.choice([1, 2, 3, 10])]) for _ in range(rng.randrange(1, 8))]
            words += (block * rng.randrange(1, 9))[:rng.randrange(1, 50)]
        assert rd.periodic_runs(words) == brute(words), words


def test_segments_hold_all_runs_and_no_rare_word():
    rng = random.Random(12)
    for _ in range(500):
        ids = [rng.randrange(rng.choice([3, 10, 40])) for _ in range(rng.randrange(0, 150))]
        found = rd.segments(ids)
        for lo, hi in found:
            assert all(ids[lo:hi].count(w) >= 4 for w in set(ids[lo:hi]))
        for start, length, _ in brute([str(i) for i in ids]):
            assert any(lo <= start and start + length <= hi for lo, hi in found)


def test_long_texts_stay_near_linear():
    began = time.time()
    assert rd.periodic_runs(["x"] * 300_000) == [(0, 300_000, 1)]
    assert rd.periodic_runs(["a", "b", "c"] * 100_000) == [(0, 300_000, 3)]
    # Every cut makes the next word rare: a chain of splits, one at each end.
    n = 40_000
    nested = [f"w{min(i, n - i) // 2}" for i in range(n)]
    assert rd.periodic_runs(nested) == []
    rng = random.Random(1)
    rd.periodic_runs([rng.choice("ab") for _ in range(30_000)])
    assert time.time() - began < 60


def test_query_against_sql(spark, con):
    rows, why = oracle.compare(rd.op11_frequency_split_runs(spark, SF), con, rd.OP11_SQL)
    assert rows and not why, why


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "a " * 6), (4, "a " * 5), (5, "x\ty\n" * 4 + "z"), (5, "x\ty\n" * 4 + "z"), (6, "w w " * 6), (7, "p q " * 50_000)]
    docs = spark.createDataFrame([(i, t, "r", 0) for i, t in texts], "doc_id long, text string, runs string, row int")
    got = rd.collapsed_runs(docs).select("row.doc_id", "row.runs", "row.row", "runs", "collapsed").collect()
    assert len(got) == len(texts) and {r[1] for r in got} == {"r"}
    found = {r[0]: ([tuple(x) for x in r[3]], r[4]) for r in got}
    assert found == {
        1: ([], ""), 2: ([], ""), None: ([(0, 6, 1)], "a"), 4: ([], "a a a a a"), 5: ([(0, 8, 2)], "x y z"),
        6: ([(0, 6, 1)], "w w"), 7: ([(0, 100_000, 2)], "p q")}
    assert rd.collapsed_runs(docs.where("false")).count() == 0


def test_overlapping_runs_drop_the_union():
    words = "a a a a a a b a a a a a a b a a a a a a b a a a a a a b".split()
    runs = rd.periodic_runs(words)
    assert (0, 28, 7) in runs and len(runs) == 5
    assert rd.without_repeats(words, runs) == ["a", "b"]


def test_tails_repeat_by_the_id():
    import zlib

    words = [f"w{i}" for i in range(50)]
    for doc_id in range(200):
        h = zlib.crc32(str(doc_id).encode())
        got = rd.repeated_tail(words, doc_id)
        if h % 10:
            assert got == words
        else:
            a, p = h // 10 % 50, 1 + (50 - h // 10 % 50) // (3 + h // 10 % 8)
            assert got == [words[i if i < a else a + (i - a) % p] for i in range(50)]
    assert rd.repeated_tail(words, None) == words and rd.repeated_tail([], 1) == []

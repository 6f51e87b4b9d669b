"""Phrase counts against a counter, the query against SQL."""

import random
import re
import tracemalloc
from collections import Counter

import oracle
from conftest import SF

from codesift.llm import collocations as co


def counted(texts, least):
    """{(lang, words): n} of all phrases of one to four words."""
    out = Counter()
    for lang, text in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            out.update((lang or "und", " ".join(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    return {p: n for p, n in out.items() if n >= least}


def test_query_against_sql(spark, con):
    rows, why = oracle.compare(co.op12_suffix_collocations(spark, SF), con, co.OP12_SQL)
    assert rows and not why, why


def test_ranges_change_nothing(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, why = oracle.compare(co.collocations(docs, per_range=700), con, co.OP12_SQL)
    assert rows and not why, why


def test_counts_on_few_words_and_hot_passages(spark, monkeypatch):
    rng = random.Random(4)
    texts = [("en", " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for _ in range(150)]
    texts += [("en", "the same hot passage, of the same words. Of The same")] * 400
    texts += [(None, "the same hot passage x \x01 y\tÄÖ ÄÖ ÄÖ")] * 50 + [("en", None), ("de", ""), ("de", "..,;\n")]
    texts += [("de", "und so weiter " * 3000)]
    docs = spark.createDataFrame([(i, t, lang, 1, "w") for i, (lang, t) in enumerate(texts)], "doc_id int, text string, lang string, n int, word string").repartition(5)
    monkeypatch.setattr(co, "BUFFER", 2000)
    for per_range in (10, 100, 10_000):
        counts, totals = co.phrase_counts(docs, 5, per_range)
        rows = counts.collect()
        assert len({(r["lang"], r["phrase"]) for r in rows}) == len(rows)
        assert {(r["lang"], r["phrase"]): r["f"] for r in rows} == counted(texts, 5)
        assert all(r["n_words"] == r["phrase"].count(" ") + 1 for r in rows)
    assert {r["lang"]: r["n"] for r in totals.collect()} == {
        lang: n for lang in ("en", "de", "und") if (n := sum(f for (la, p), f in counted(texts, 1).items() if la == lang and " " not in p))}


def test_cut_ties_and_containment(spark):
    rows = [("x", "a", 1, 100), ("x", "b", 1, 100), ("x", "c", 1, 100), ("x", "a b", 2, 100), ("x", "b c", 2, 80), ("x", "a b c", 3, 80),
            ("x", "d", 1, 10**13), ("x", "e", 1, 10**13), ("x", "d e", 2, 10**13)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, n_words int, f long")
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in co.scored(counts).collect()}
    # "a b" and "b c" lie inside "a b c", which has 80 % or more of each.
    # Of its cuts "a b" + "c" scores less than "a" + "b c".
    assert got == {"a b c": (80, 100, 100, 800_000), "d e": (10**13, 10**13, 10**13, 10**6)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert co.collocations(docs).count() == 0


def test_a_range_is_read_piece_by_piece():
    rng = random.Random(7)
    pieces = [b"".join(sorted(b" ".join(rng.choices([b"w%d" % i for i in range(3000)], k=rng.randrange(2, 5))) + b"\n" for _ in range(5000))) for _ in range(20)]
    words, rows = co._read(b"".join(pieces))
    tracemalloc.start()
    vocabulary, got = co._united([co._read(p) for p in pieces])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert vocabulary == words and (got == rows).all()
    # The numbers of the words, once in pieces and once in all, not some ten times the text.
    assert peak < 2.5 * sum(map(len, pieces)), peak

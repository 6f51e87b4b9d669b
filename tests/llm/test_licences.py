"""Base places against brute force; templates on planted notices."""

import re

import pytest
from conftest import SF

from codesift.llm import licences as lc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lower(text))
    found = [(i, label) for phrase, label in lc.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = lc.op4_licence_index(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        text = docs[r["doc_id"]]
        assert ("apache-2.0" in r["labels"]) == ("apache license, version 2.0" in text.lower())
        assert ("mit" in r["labels"].split(",")) == ("mit license" in text.lower())


@pytest.fixture(scope="module")
def index():
    t = lc.Templates()
    t.weighted({w: 5.0 for w in t.vocabulary})
    return t


def test_every_template_finds_itself(index):
    for label, notice, _ in lc.TEMPLATES:
        got = lc.scan_words(lc.words_of("Some prose before. " + notice + ". And after it."), index)
        assert label in got["labels"].split(","), notice


def test_long_notices_hide_no_other_licence():
    """Words that are common in the corpus count beside many rare ones."""
    t = lc.Templates()
    t.weighted({w: 1.0 if w in lc.words_of("licensed apache license version 2 0") else 9.0 for w in t.vocabulary})
    for gap in (" ", " and then " * 40):
        got = lc.scan_words(lc.words_of(gap.join(n for label, n, _ in lc.TEMPLATES if label in ("bsd", "mit", "isc", "apache-2.0"))), t)
        assert {"bsd", "mit", "isc", "apache-2.0"} <= set(got["labels"].split(","))


def test_words_out_of_place_or_without_key_phrase_do_not_count(index):
    for text in ["license the under mit version apache 2 0", "licensed released software", "license " * 500, "apache " * 100 + "license"]:
        assert lc.scan_words(lc.words_of(text), index)["labels"] in ("", "apache-2.0" if "apache license" in text and "2 0" in text else "")


def test_anchors_are_the_rarest_key_words(index):
    t = lc.Templates()
    t.weighted({w: {b"apache": 9.0, b"version": 1.0, b"license": 2.0}.get(w, 5.0) for w in t.vocabulary})
    apache = [label for label, _, _ in lc.TEMPLATES].index("apache-2.0")
    assert [w for w, _ in t.anchors[apache]] == [b"apache", b"0"] or [w for w, _ in t.anchors[apache]] == [b"apache", b"2"]
    for keys, anchors in zip(t.keys, t.anchors):
        assert anchors and all(any(w in key for key in keys) for w, _ in anchors)


def test_hostile_long_texts():
    """Two million licence words, in linear time and bounded memory."""
    import time
    import tracemalloc

    t = lc.Templates()
    t.weighted({w: 5.0 for w in t.vocabulary})
    for text in ("license " * 2_000_000, "mit license " * 1_000_000, "mit the license of " * 250_000 + "General Public License"):
        words = lc.words_of(text)
        began = time.time()
        got = lc.scan_words(words, t)
        assert time.time() - began < 20 and got["n_words"] == len(words)
    assert got["base_labels"] == "gpl"
    words = lc.words_of("license " * 2_000_000)
    tracemalloc.start()
    lc.scan_words(words, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "CC BY cc-by é", "a"), (3, "CC BY cc-by é", "a"), (None, "General Public License", "a"), (4, "w " * 100_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) for r in lc.scan(docs).collect())
    assert got[0] == ("1", 0, 0, None, None, "") and got[1] == ("2", 0, 0, None, None, "")
    assert got[2] == got[3] == ("3", 5, 2, 0, 2, "cc-by")
    assert got[4][:3] == ("4", 100_000, 0) and got[5] == ("None", 3, 1, 0, 0, "gpl")
    assert lc.scan(docs.where("false")).count() == 0

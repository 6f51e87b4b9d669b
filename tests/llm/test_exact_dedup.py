"""Exact groups against SQL; the perfect hash against its definition."""

import hashlib

import numpy as np
import oracle
from conftest import SF

from codesift.llm import exact_dedup as ed


def digests(n, salt=""):
    return np.frombuffer(b"".join(hashlib.sha256(f"{salt}{i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 63, 1000, 20_000):
        levels = ed.build(digests(n))
        assert sorted(ed.slots(levels, digests(n))) == list(range(n))
    found = ed.slots(levels, digests(500, "x"))
    held = digests(20_000)[np.argsort(ed.slots(levels, digests(20_000)))]
    # A stranger may meet a slot; its bytes tell it apart.
    assert not any((held[s] == d).all() for s, d in zip(found, digests(500, "x")) if s >= 0)


def test_query_against_sql(spark, con):
    rows, why = oracle.compare(ed.op1_perfect_hash_dedup(spark, SF), con, ed.OP1_SQL)
    assert rows and not why, why


def test_odd_rows(spark):
    texts = [(5, "a  b"), (1, "a\tb"), (9, "a\nb"), (3, None), (8, ""), (None, ""), (None, "z"), (None, "z"), (7, "x"), (7, "x"), (10, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in texts], "doc_id long, text string, kept int, digest string")
    keys = docs.select("doc_id", ed.text_digest().alias("digest"))
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in ed.grouped(keys).collect()]
    want = [(5, 1, 3, False), (1, 1, 3, True), (9, 1, 3, False), (3, 3, 3, True), (8, 3, 3, False), (None, 3, 3, False),
            (None, None, 2, True), (None, None, 2, False), (7, 7, 2, True), (7, 7, 2, False), (10, 10, 1, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = ed.unique_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept.collect()) == sorted(
        [("1", "a\tb"), ("3", ""), ("None", "z"), ("7", "x"), ("10", "long ")])
    assert ed.unique_rows(docs.where("false")).count() == 0


def test_a_hot_group_over_both_loads(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('t', id % 1700) END AS text")
    keys = docs.select("doc_id", ed.text_digest().alias("digest"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in ed.grouped(keys).collect()}
    groups = {}
    for r in docs.collect():
        groups.setdefault(r["text"], []).append(r["doc_id"])
    assert got == {d: (min(g), len(g)) for g in groups.values() for d in g}

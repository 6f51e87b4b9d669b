"""Edited texts and neighbours by brute force; estimates against true values."""

import hashlib
import random

import numpy as np
from conftest import SF

from codesift.llm import sketches as sk
from codesift.llm.simhash import hashes


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        cut = len(t) // 4
        out.append(t[:len(t) - cut] + texts[(i + 1) % len(texts)][:cut] if cut else t)
    return out


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0]))
    texts = [t or "" for _, t in docs]
    changed = edited(texts)
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for k, (doc_id, _) in enumerate(docs):
        r, n = got[doc_id], texts[(k + 1) % len(texts)]
        assert r["n_chars"] == len(texts[k])
        assert r["edited_sha256"] == hashlib.sha256(changed[k].encode()).hexdigest()
        assert r["fingerprint"] == sk.as_text(sk.sketch(texts[k])) and r["edited_fingerprint"] == sk.as_text(sk.sketch(changed[k]))
        assert r["near_edited"] == sk.resemblance(sk.sketch(texts[k]), sk.sketch(changed[k]))
        assert r["near_next"] == sk.resemblance(sk.sketch(texts[k]), sk.sketch(n))


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(sk.op6_bottom_k(spark, SF).collect(), docs)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sk, "RANGE_BYTES", 9000)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(None, "a text without an id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(sk.beside_next(df).collect(), docs)


def test_estimates():
    rng = random.Random(5)
    errors, counts = [], []
    for _ in range(60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        b = a[:rng.randrange(3000)] + [f"v{rng.randrange(10**6)}" for _ in range(1500)]
        x, y = set(hashes(" ".join(a), 5).tolist()), set(hashes(" ".join(b), 5).tolist())
        p, q = sk.sketch(" ".join(a)), sk.sketch(" ".join(b))
        errors.append(abs(sk.resemblance(p, q) - len(x & y) / len(x | y)))
        errors.append(abs(sk.containment(q, p) - len(x & y) / len(y)) / 2)
        counts.append(sk.distinct_shingles(p) / len(x) - 1)
        halves = sk.merged(sk.sketch(" ".join(a[:1500])), sk.sketch(" ".join(a[1496:])))
        assert (halves == p).all()
    assert np.mean(errors) < 0.05 and abs(np.mean(counts)) < 0.05
    assert (sk.from_text(sk.as_text(p)) == p).all()
    assert sk.resemblance(sk.sketch(""), sk.sketch(None)) == 1.0 and sk.resemblance(sk.sketch("a"), sk.sketch("")) == 0.0


def test_merging_in_spark(spark):
    rng = random.Random(2)
    parts = [(k % 2, sk.as_text(sk.sketch(" ".join(f"w{rng.randrange(999)}" for _ in range(200))))) for k in range(30)] + [(2, "")]
    df = spark.createDataFrame(parts, "k int, sketch string")
    got = {r["k"]: r["sketch"] for r in sk.merge_sketches(df, ["k"]).collect()}
    for k in (0, 1):
        union = np.unique(np.concatenate([sk.from_text(s) for i, s in parts if i == k]))[:sk.K]
        assert got[k] == sk.as_text(union)
    assert got[2] == ""


def test_odd_rows(spark):
    docs = [(4, None), (2, ""), (9, "one"), (7, "ab cd ef gh ij kl é" * 30), (None, "x y z " * 20_000), (1, "q")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fingerprint string")
    check(sk.beside_next(df).collect(), docs)
    one = sk.beside_next(df.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert sk.beside_next(df.where("false")).count() == 0
    twice = sk.beside_next(df.where("doc_id = 7").unionByName(df.where("doc_id = 7")))
    assert [r["near_next"] for r in twice.collect()] == [1.0, 1.0]

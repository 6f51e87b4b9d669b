"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from conftest import SF

from codesift.llm import simhash


def brute_fingerprint(text, words=3):
    parts = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in (text or "")).split(" ") if w]
    parts = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in parts]
    if not parts:
        return 0
    runs = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    """{index: smallest index reachable}"""
    fps = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= radius):
            a, b = sorted((root(i), root(i + 1 + int(j))))
            label[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints_of_odd_texts():
    long_run = "x" * 100_000
    for text in [None, "", " \n\t", "One", "one TWO", "a b c", "a b c d " * 300, "é ß Ü\x0bz q r", long_run, "ab " * 70_000]:
        got = simhash.fingerprint(simhash.hashes(text, 3)) & (1 << 64) - 1
        assert got == brute_fingerprint(text), (text or "")[:20]


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    fps = [brute_fingerprint(t) for _, t in docs]
    roots = brute_components(fps)
    want = {d: (f"{f:016x}", docs[r][0]) for (d, _), f, r in zip(docs, fps, roots)}
    rows = simhash.op3_pigeonhole_simhash(spark, SF).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


@pytest.mark.parametrize("radius,most", [(3, 4096), (3, 8), (4, 40)])
def test_links_of_dense_groups(spark, radius, most):
    """Groups of near copies beyond the bucket size lose no link."""
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1, 1 << 63]
    for _ in range(2):
        center = rng.getrandbits(64)
        fps += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(150)]
    at = rng.getrandbits(64)
    for _ in range(60):  # a chain
        at ^= sum(1 << b for b in rng.sample(range(64), radius))
        fps.append(at)
    fps = list(dict.fromkeys(fps))
    rng.shuffle(fps)
    roots = brute_components(fps, radius)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    rows = spark.createDataFrame(signed, "doc_id long, fp long")
    reps = rows.selectExpr("fp", "doc_id AS first")
    from codesift.llm.components import components
    from codesift.session import durable

    found = components(simhash.links(durable(reps), len(fps), radius, most)).collect()
    label = {r["v"]: r["root"] for r in found}
    groups = {}
    for i, f in signed:
        groups.setdefault(label.get(f, f), []).append(i)
    got = {i: min(g) for g in groups.values() for i in g}
    assert [got[i] for i in range(len(fps))] == roots


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "A  B\nC"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.labelled(simhash.fingerprints(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 1), (0, 3), (1, 1), (2, 1), (3, 3), (3, 3)]
    extra = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (2, "A b", 6, "y")], "doc_id long, text string, fp long, component_id string")
    kept = simhash.one_of_each(extra)
    assert kept.columns == extra.columns
    assert [tuple(r) for r in kept.collect()] == [(1, "a b", 5, "x")]
    empty = docs.where("false")
    assert simhash.labelled(simhash.fingerprints(empty)).count() == 0
    assert simhash.one_of_each(empty).count() == 0

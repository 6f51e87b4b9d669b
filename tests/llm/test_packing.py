"""Bucket tops against all choices; batches against their budget."""

import itertools
import random

from conftest import SF

from codesift.llm import packing as pk


def padding(hist, tops):
    return sum(next(t for t in tops if t >= top) * n - tokens for top, n, tokens in hist)


def test_tops_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        hist = [(x, n, x * n) for x in lengths for n in [rng.randrange(1, 30)]]
        for buckets in (1, 2, 3, 4, 20):
            tops = pk.best_tops(hist, buckets)
            assert len(tops) <= buckets and tops[-1] == lengths[-1]
            best = min(padding(hist, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
            assert padding(hist, tops) == best
    assert pk.best_tops([], 4) == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = pk.op5_length_buckets(spark, SF).collect()
    assert len(rows) == docs
    batches = {}
    for r in rows:
        assert r["n_tokens"] + r["padding"] == r["bucket_len"] and r["padding"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    last = {b: max(x for c, x in batches if c == b) for b, _ in batches}
    for (bucket, batch), members in batches.items():
        assert sorted(r["place"] for r in members) == list(range(len(members)))
        width = max(1, pk.BUDGET // max(1, members[0]["bucket_len"]))
        assert len(members) == width or batch == last[bucket] and len(members) < width


def test_odd_rows(spark):
    rows = [(1, 0), (1, 0), (None, 3), (2, 10**6), (3, 40_001), (4, 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = pk.packed_batches(df, buckets=2, budget=100, chunk_rows=2).collect()
    assert sorted((r["n_tokens"], r["bucket_len"]) for r in got) == [(0, 40_001), (0, 40_001), (3, 40_001), (40_000, 40_001), (40_001, 40_001), (10**6, 10**6)]
    assert len({(r["bucket"], r["batch"]) for r in got}) == 6
    assert pk.packed_batches(df.where("false")).count() == 0

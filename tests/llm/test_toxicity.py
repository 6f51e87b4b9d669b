"""Held-out accuracy, the pull of counterfactuals, and odd rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codesift.llm import toxicity as tx

TENTH = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = tx.op9_counterfactual_toxicity(spark, TENTH)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{TENTH}/labels.parquet")
    r = rows.where("held_out").join(labels, "doc_id").agg(
        F.sum(F.col("predicted") * F.col("toxic")).alias("hit"), F.sum("predicted").alias("said"), F.sum("toxic").alias("is")).first()
    assert r["hit"] / r["said"] > 0.88 and r["hit"] / r["is"] > 0.85


def test_counterfactuals():
    words = Counter({b"the": 3, b"women": 2})
    swapped = tx.counterfactual(words, 5)
    assert b"women" not in swapped and sum(swapped.values()) == 5
    assert sum(tx.counterfactual(Counter({b"the": 3}), 9).values()) == 4


def test_penalty_narrows_the_gap_between_groups():
    """One group is named in toxic sentences only; the penalty keeps the model
    from learning the name."""
    rng, features = np.random.default_rng(0), tx.Features()
    plain = [f"w{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(50)]
    rows = []
    for k in range(300):
        toxic = k % 2
        words = Counter(w.encode() for w in rng.choice(plain, 12))
        words.update([b"idiot"] * (toxic and k % 4 == 1) + [b"muslims" if toxic else b"people"])
        x = features.of(words)
        y = features.of(tx.counterfactual(words, k), sum(words.values()))
        change = {f: y.get(f, 0) - x.get(f, 0) for f in {**x, **y} if y.get(f, 0) != x.get(f, 0)}
        rows.append((toxic, *[np.array(list(v)) for v in (x.keys(), x.values())], np.array(list(change.keys()), np.int64), np.array(list(change.values()))))

    def gap(penalty):
        model = tx.fit(rows, penalty=penalty)
        z = [model.logit(features.of(Counter([b"the", w, b"came"]))) for w in (b"muslims", b"jews")]
        return abs(z[0] - z[1])

    assert gap(2.0) < 0.5 * gap(0.0)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "idiot " * 50_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.trained(docs, none) is None
    kept = tx.clean_rows(docs, none)
    assert kept.columns == docs.columns and kept.count() == 4
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (77, 1)], "doc_id long, toxic int")
    assert tx.clean_rows(docs, odd).count() <= 4
    assert tx.clean_rows(docs.where("false"), odd).count() == 0

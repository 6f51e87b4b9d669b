"""Counterfactual-regularised toxicity classifier.

A linear model over hashed words, word starts and word ends is trained on a
bounded sample of labelled documents (``SAMPLE`` rows; it is fitted on
executors, in one task).  Beside the logistic loss, each pass penalises the
squared difference between a document's score and the score of its
counterfactual: identity terms swapped for others of their group, or, where a
document names none, one term put in.  So the mention of a group by itself
moves a score little.

The operating point is set on a fifth of the sample that is not trained on:
the threshold with the best F1 becomes score 0.3.

Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2;
labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null text is an empty text, scored by the intercept; null or
unmatched labels are not trained on; without any labelled row (or with one
class only) every score is 0; repeated rows are scored alike; further columns
are left as they are; an empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codesift.llm.common import packed, table
from codesift.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 8_000
BITS = 17
EPOCHS = 8
PENALTY = 0.5
THRESHOLD = 0.3
WORD_CACHE = 200_000
SEED = 13

# Identity terms by group; a term may be swapped for any of its group.
IDENTITIES = [
    ["women", "men", "girls", "boys", "ladies", "mothers", "fathers"],
    ["female", "male", "transgender", "nonbinary"],
    ["gay", "lesbian", "bisexual", "straight", "queer", "homosexual"],
    ["muslims", "jews", "christians", "hindus", "buddhists", "atheists", "catholics"],
    ["muslim", "jewish", "christian", "hindu", "buddhist", "atheist", "catholic"],
    ["black", "white", "asian", "african", "arab", "latino", "indigenous"],
    ["immigrants", "refugees", "foreigners", "migrants"],
    ["disabled", "deaf", "blind", "autistic", "elderly", "young"],
    ["frauen", "männer", "juden", "christen", "muslime", "ausländer"],
    ["femmes", "hommes", "juifs", "chrétiens", "musulmans", "étrangers"],
    ["mujeres", "hombres", "judíos", "cristianos", "musulmanes", "extranjeros"],
]

_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> Counter:
    """Lower-cased words of letters, with their counts."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split())


def word_features(word: bytes) -> list[int]:
    s = word.decode("utf-8", "ignore")
    names = ["=" + s, *[s[:k] + "*" for k in (3, 4, 5, 6, 7) if len(s) > k], *["*" + s[-k:] for k in (4,) if len(s) > k]]
    return [xxhash.xxh32_intdigest(n.encode()) & (1 << BITS) - 1 for n in names]


class Features:
    """Features of texts; words are looked up in a cache of bounded size."""

    def __init__(self):
        self.cache: dict[bytes, list[int]] = {}

    def of(self, words: Counter, total: int = 0) -> dict[int, float]:
        """Feature values: log of one plus the occurrences in 100 words, of
        ``total`` words if given."""
        if len(self.cache) > WORD_CACHE:
            self.cache.clear()
        cache, total, out = self.cache, total or sum(words.values()), {}
        for w, n in words.items():
            fs = cache.get(w)
            if fs is None:
                fs = cache[w] = word_features(w)
            for f in fs:
                out[f] = out.get(f, 0) + n
        per = 100.0 / max(total, 1)
        return {f: math.log1p(n * per) for f, n in out.items()}


def counterfactual(words: Counter, draw: int) -> Counter:
    """The words with identity terms swapped within their group; with one term
    put in where there is none.  ``draw`` chooses."""
    out, swapped = Counter(words), False
    for g, group in enumerate(IDENTITIES):
        for k, term in enumerate(group):
            t = term.encode()
            if t in words:
                other = group[(k + 1 + (draw >> g) % (len(group) - 1)) % len(group)].encode()
                out[t] -= words[t]
                out[other] += words[t]
                swapped = True
    if not swapped:
        group = IDENTITIES[draw % len(IDENTITIES)]
        out[group[draw // 64 % len(group)].encode()] += 1
    return +out


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float

    def logit(self, x: dict[int, float]) -> float:
        if not x:
            return self.intercept
        i = np.fromiter(x.keys(), np.int64, len(x))
        return self.intercept + float(self.weights[i] @ np.fromiter(x.values(), np.float64, len(x)))


def sigmoid(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-z)) if z >= 0 else math.exp(z) / (1.0 + math.exp(z))


def fit(rows: list[tuple], epochs: int = EPOCHS, penalty: float = PENALTY, rate: float = 0.3, seed: int = SEED) -> Model:
    """Train on rows of (label, index, value, changed index, changed value),
    where the last two are the counterfactual's values minus the text's."""
    # Steps shrink from the start, so a rare feature does not settle a text alone.
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 10.0)
    b, b2 = -2.0, 10.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, i, v, ci, cv = rows[k]
            gb = sigmoid(b + float(w[i] @ v)) - y
            # Logistic loss on the text, then the pull of the two scores together.
            for at, g in ((i, gb * v + 1e-4 * w[i]), (ci, penalty * 2.0 * float(w[ci] @ cv) * cv)):
                g2[at] += g * g
                w[at] -= rate * g / np.sqrt(g2[at])
            b2 += gb * gb
            b -= rate * gb / math.sqrt(b2)
    return Model(w, b)


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float | None:
    """Logit with the best F1, in the middle of the gap below it."""
    order = np.argsort(-logits, kind="stable")
    z, hits = logits[order], np.cumsum(labels[order])
    if not len(z) or not hits[-1] or hits[-1] == len(z):
        return None
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
    f1[:-1][z[:-1] == z[1:]] = -1.0  # equal scores stay together
    k = int(np.argmax(f1))
    return float(z[k] + z[k + 1]) / 2 if k + 1 < len(z) else float(z[k]) - 1.0


_SAMPLE = "label int, tested boolean, i array<int>, v array<float>, ci array<int>, cv array<float>"


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        out = {c: [] for c in ("label", "tested", "i", "v", "ci", "cv")}
        for text, label, draw in zip(*[batch.column(c) for c in ("text", "label", "draw")]):
            words, draw = words_of(text.as_py()), draw.as_py()
            x = features.of(words)
            y = features.of(counterfactual(words, draw), sum(words.values()))
            change = {f: y.get(f, 0.0) - x.get(f, 0.0) for f in {**x, **y} if y.get(f, 0.0) != x.get(f, 0.0)}
            out["label"].append(label.as_py())
            out["tested"].append(draw % 5 == 0)
            for c, values in (("i", x.keys()), ("v", x.values()), ("ci", change.keys()), ("cv", change.values())):
                out[c].append(list(values))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("label", pa.int32()), ("tested", pa.bool_()), ("i", pa.list_(pa.int32())), ("v", pa.list_(pa.float32())),
            ("ci", pa.list_(pa.int32())), ("cv", pa.list_(pa.float32()))]))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values, at = chunk.flatten().to_numpy(), chunk.offsets.to_numpy() - chunk.offsets[0].as_py()
        out += [values[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def _train(rows: pa.Table) -> pa.Table:
    # Draws made the order of rows; sort by content so that reruns agree.
    data = list(zip(rows["label"].to_pylist(), *[_lists(rows[c]) for c in ("i", "v", "ci", "cv")], rows["tested"].to_pylist()))
    data.sort(key=lambda r: (len(r[1]), r[0], float(r[2].sum()), r[1][:8].tolist()))
    learnt, tested = [r[:5] for r in data if not r[5]], [r for r in data if r[5]]
    labels = {r[0] for r in learnt}
    if len(labels) < 2:
        return pa.table({"weights": pa.array([], pa.list_(pa.float32())), "intercept": pa.array([], pa.float64())})
    model = fit(learnt)
    logits = np.array([model.intercept + float(model.weights[r[1]] @ r[2]) for r in tested])
    cut = best_cut(logits, np.array([r[0] for r in tested]))
    shift = 0.0 if cut is None else math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return pa.table({
        "weights": pa.array([model.weights.astype(np.float32)], pa.list_(pa.float32())), "intercept": pa.array([model.intercept + shift])})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from at most about ``sample`` labelled rows of ``docs``, the same
    ones in every run; null without labelled rows of both classes."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    n = known.count()
    # The chosen ids are few, so the texts are not dealt out for the join.
    share = min(1.0, sample / max(n, 1))
    pick = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30))
    chosen = durable(known.where(pick < F.lit(int(share * (1 << 30)))).withColumn("draw", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(1 << 20))))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("text", "label", "draw").mapInArrow(_sample_features, _SAMPLE)
    got = durable(rows).groupBy(F.lit("all")).applyInArrow(_train, "weights array<float>, intercept double").collect()
    return Model(np.array(got[0]["weights"], np.float32), got[0]["intercept"]) if got else None


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """Scores of ``docs(..., text)``; the text is dropped."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = [
                sigmoid(model.logit(features.of(words_of(t.as_py())))) if model else 0.0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(scores, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, docs.drop("text").schema.add("score", "double"))


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold."""
    model = trained(docs, labels)
    rows = scored(packed(docs, text=F.col("text")), model)
    return rows.where(F.col("score") < THRESHOLD).select("row.*")


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

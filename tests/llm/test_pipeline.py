"""Each stage of the pipeline against a plain version on its own input."""

import re

import corpus_pipeline
import pytest
from conftest import SF
from test_simhash import brute_components, brute_fingerprint

from codesift.llm import toxicity


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for name in ("toxicity", "exact_dedup", "simhash_near_dedup", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_toxic_documents_go(spark, stages):
    docs = stages["documents"]
    model = toxicity.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.scored(docs.select("doc_id", "text"), model).collect() if r["score"] < toxicity.THRESHOLD}
    assert set(rows(stages["toxicity"])) == want


def test_exact_copies_go(stages):
    first = {}
    for d, r in sorted(rows(stages["toxicity"]).items()):
        first.setdefault(re.sub("[ \t\n\x0b\x0c\r]+", " ", r["text"]), d)
    assert set(rows(stages["exact_dedup"])) == set(first.values())


def test_near_copies_go(stages):
    docs = sorted((d, r["text"]) for d, r in rows(stages["exact_dedup"]).items())
    roots = brute_components([brute_fingerprint(t) for _, t in docs])
    assert set(rows(stages["simhash_near_dedup"])) == {docs[r][0] for r in roots}


def test_mix_and_packing(stages):
    taken = {}
    for r in stages["mixing"].collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert set(taken) <= set(rows(stages["simhash_near_dedup"])) and max(taken.values()) <= 2
    assert stages["packing"].count() == stages["mixing"].count()


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() and set(got.columns) >= {"doc_id", "bucket", "batch"}


ODD = [(1, None, "de"), (2, "", "en"), (3, "a b c d e", None), (3, "a b c d e", None), (None, "of its own, quite another text", "en"), (9, "w " * 50_000, "en"),
       (10, "one two three four five six seven eight", "en")] + [(20, "a row that is there many times", "en")] * 50


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, lang, None if i == 10 else f"s{(i or 0) % 3}", len(t or ""), 0.5, "x", 7) for i, t, lang in ODD],
        "doc_id long, text string, lang string, source string, n_chars long, score double, row string, fp int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        kept = sorted(str((r["doc_id"], (r["text"] or "")[:5])) for r in got.collect())
        if name in ("exact_dedup", "simhash_near_dedup"):
            assert kept == sorted(str(x) for x in [(1, ""), (3, "a b c"), (None, "of it"), (9, "w w w"), (10, "one t"), (20, "a row")]), name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    packed = corpus_pipeline.packed_buckets(spark, docs, SF)
    assert packed.count() == len(ODD) and corpus_pipeline.packed_buckets(spark, docs.where("false"), SF).count() == 0

"""What is kept between runs: facts by content, committed findings, streams."""

import os

import pytest
from pyspark.sql import functions as F

from codesift.operators import fact_store as fs, facts as fx, report
from codesift.schemas import FINDINGS
from codesift.sources import sinks
from codesift.streaming import incremental

TEXTS = {
    "a/x.py": "import os\nclass A(B):\n    'doc'\n    @wrap(1)\n    def f(self, x=2) -> int:\n        def g():\n            return os.system(x)\n        return g()\n",
    "b/x.py": "x = 1\n", "c/x.py": "x = 1\n", "c/y.py": "x = 1\n", "d.py": "def (\n", "e.py": "", "f.py": None, "g.txt": "x = 1\n",
    "h.py": "def f():\r\n  try:\r\n    pass\r\n  except:\r\n    eval('1')\r\n", "long.py": "y = '" + "z" * 5000 + "'\n", "many.py": "k = [1]\n" * 500,
}


def plain(df):
    return sorted(map(str, df.collect()))


def test_stored_facts_are_the_facts(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(fs, "SPLIT", 2)
    corpus = files(TEXTS)
    store = fs.FactStore(spark, str(tmp_path / "s"))
    assert store.facts().count() == 0 and store.parsed().count() == 0
    # A first run over a few files, a second over all of them.
    store.add(corpus.where("path like 'b/%' or path like 'a/%'"))
    assert store.parsed().count() == 2
    lean = store.add(corpus)
    assert sorted(lean.columns) == ["digest", "file_id", "path"] and lean.count() == 9
    assert plain(store.facts_of(lean)) == plain(fx.extract_facts(corpus))
    runs = store.parsed().groupBy("run").count().collect()
    assert sorted(r["count"] for r in runs) == [2, 5] and store.parsed().where("n_facts = 0").count() == 1
    # Nothing new: nothing is parsed or written.
    store.add(corpus)
    assert store.parsed().select("run").distinct().count() == 2
    assert plain(fs.stored_facts(corpus, str(tmp_path / "s"))) == plain(fx.extract_facts(corpus))


def test_a_run_that_died_is_not_read(spark, files, tmp_path):
    store, corpus = fs.FactStore(spark, str(tmp_path / "s")), files({"a.py": "x = 1\n", "b.py": "f()\n"})
    fx.extract_facts(corpus).withColumn("digest", F.lit("0")).select(fs._STORED.names).write.parquet(f"{store.folder}/facts/run=dead")
    assert store.facts().count() == 0
    assert plain(store.facts_of(store.add(corpus))) == plain(fx.extract_facts(corpus))
    # Other names, other contexts, another store.
    other = fs.FactStore(spark, str(tmp_path / "s"), frozenset({"f"}))
    assert other.folder != store.folder and other.parsed().count() == 0
    assert plain(other.facts_of(other.add(corpus))) == plain(fx.extract_facts(corpus, frozenset({"f"})))


def findings(spark, n, severity="High"):
    return spark.range(n).select(*[
        F.col("id").cast(f.dataType).alias(f.name) if f.name in ("file_id", "line") else F.lit(severity if f.name == "severity" else "x" if f.name == "file" else None).cast(f.dataType).alias(f.name)
        for f in FINDINGS])


def test_a_run_counts_once(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.read_findings(spark, path).count() == 0 and sinks.drop_leftovers(spark, path) == 0
    sinks._stage(findings(spark, 5), path, "r1")                # died before the commit
    assert sinks.read_findings(spark, path).count() == 0
    assert sinks.write_findings_once(findings(spark, 5), path, "r1")
    assert not sinks.write_findings_once(findings(spark, 5), path, "r1")   # died after it
    assert sinks.write_findings_once(findings(spark, 2, "Low"), path, "r2")
    rows = sinks.read_findings(spark, path).collect()
    assert sorted((r["run"], r["file_id"], r["severity"]) for r in rows) == [("r1", i, "High") for i in range(5)] + [("r2", i, "Low") for i in range(2)]
    assert all(r["scanned_at"] for r in rows)
    assert sinks.drop_leftovers(spark, path) == 1 and sinks.read_findings(spark, path).count() == 7


def test_two_drivers_at_once_and_a_torn_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    one, two = sinks._stage(findings(spark, 3), path, "r"), sinks._stage(findings(spark, 3), path, "r")
    assert sinks._commit(spark, path, "r", one) and not sinks._commit(spark, path, "r", two)
    assert sinks.read_findings(spark, path).count() == 3 and not os.path.exists(f"{path}/{two}")
    # Died while the manifest was being written.
    for torn in ("", "data/run=t/att"):
        (tmp_path / "out" / "commits" / "t").write_text(torn)
        (tmp_path / "out" / "commits" / ".t.crc").unlink(missing_ok=True)
        assert sinks.read_findings(spark, path).count() == 3
        assert "t" not in sinks.committed(spark, path)
    assert sinks.write_findings_once(findings(spark, 1), path, "t") and sinks.read_findings(spark, path).count() == 4


def test_no_findings_are_a_run_too(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.write_findings_once(findings(spark, 0), path, "none")
    assert not sinks.write_findings_once(findings(spark, 4), path, "none")
    assert sinks.read_findings(spark, path).count() == 0


@pytest.fixture
def arriving(spark, tmp_path):
    """Findings of several places over some days, in four batches."""
    rows = []
    for i in range(240):
        rows.append((i % 20, f"f{i % 20}", i % 3, "t", ["High", "Low", "Medium", None][i % 4], f"r{i}", f"2024-01-0{1 + i % 5} 0{i % 9}:00:00", i % 4))
    df = spark.createDataFrame(rows, "file_id long, file string, line int, type string, severity string, rule_id string, at string, batch int")
    full = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in FINDINGS], F.to_timestamp("at").alias("found_at"), "batch")
    return full.cache()


@pytest.mark.parametrize("kind", ["merged", "counted"])
def test_streams_equal_the_batch(spark, tmp_path, arriving, kind):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    state = {"merged": incremental.merged_stream, "counted": incremental.counted_stream}[kind]
    for batch in (2, 0, 3, 1):
        arriving.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(source)
        stream = spark.readStream.schema(arriving.drop("batch").schema).parquet(source)
        incremental.write_updates(state(stream), out, checkpoint).awaitTermination(180)
    keys = ["since"] + (report.PLACE if kind == "merged" else [])
    got = incremental.latest(spark, out, keys)
    parts = []
    for day in range(1, 6):
        some = arriving.where(F.to_date("found_at") == f"2024-01-0{day}").drop("batch", "found_at")
        whole = report.dedup_findings(some) if kind == "merged" else report.severity_counts(some)
        parts += [(f"2024-01-0{day}", *r) for r in whole.collect()]
    names = [c for c in got.columns if c != "since"]
    order = (list(FINDINGS.names) + ["n_merged"]) if kind == "merged" else ["critical", "high", "medium", "low"]
    assert sorted(names) == sorted(order)
    assert sorted(map(str, ((str(r["since"])[:10], *[r[c] for c in order]) for r in got.collect()))) == sorted(map(str, parts))


def test_rows_beyond_the_delay_end(spark, tmp_path, arriving):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for day in ("2024-01-05", "2024-01-05", "2024-01-01"):
        arriving.where(F.to_date("found_at") == day).drop("batch").write.mode("append").parquet(source)
        stream = spark.readStream.schema(arriving.drop("batch").schema).parquet(source)
        incremental.write_updates(incremental.counted_stream(stream, delay="1 hour"), out, checkpoint).awaitTermination(180)
    # The first of January came when its window had ended.
    assert [str(r["since"])[:10] for r in incremental.latest(spark, out, ["since"]).collect()] == ["2024-01-05"]

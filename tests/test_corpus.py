"""Sources, sinks, filters and whole scans on a small tree of files."""

import json

import pytest
from pyspark.sql import functions as F

from codesift.functions import text as tx
from codesift.operators import graph, report, score, search, secrets, select
from codesift.plans import scan
from codesift.schemas import FILES
from codesift.sources import catalogues, corpus, sinks
from codesift.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for name, content in {
        "src/app.py": b'import os\nq = request.args.get("a")\nz = 1\nos.system(q)\npassword = "hunter22"\n',
        "src/bad.py": b"def (\n",
        "src/__init__.py": b"import random\n",
        "src/_gen/deep/util.py": b"eval(x)\n",
        "src/web.js": b'const token = "abc";\ndocument.write(x)\n',
        "src/latin.py": b"s = 1\nx = '\xe9'\n",
        "node_modules/m.js": b"eval(x)\n",
        "conf/prod.env": b"# c\nDB_PASSWORD=abcdef\nEMPTY_KEY=\nNAME=x\nAPI_KEY=a=b\nTOKEN=1234\nAUTHOR=12345\n",
        "conf/.env": b"SECRET=zz\n",
        "requirements.txt": b"requests==2.0.0\n",
        "bin/x.py": b"\xff\xfe\x00\x01" * 10,
        "big.py": b"# " + b"x" * (1024 * 1024 - 1),
        "fits.py": b"# " + b"x" * (1024 * 1024 - 2),
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


def names(df, root):
    return sorted(r["path"].split("/proj/")[1] for r in df.select("path").collect())


def test_read_corpus(spark, tree):
    files = corpus.read_corpus(spark, tree)
    assert "big.py" not in names(files, tree) and "fits.py" in names(files, tree)
    assert len(names(corpus.read_corpus(spark, tree, max_bytes=None), tree)) == 13
    assert "bin/x.py" not in names(corpus.read_corpus(spark, tree, skip_binary=True), tree)
    assert {"conf/.env", "src/__init__.py", "src/_gen/deep/util.py"} <= set(names(files, tree))
    assert not {n for n in names(corpus.read_corpus(spark, tree, hidden=False), tree) if "/_" in n or "/." in n}
    text = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.collect()}
    assert text["latin.py"] == "s = 1\nx = '�'\n"
    raw = corpus.read_binary(spark, tree).where(F.col("length") <= 100)
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,100)]" in plan
    listing = raw.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing.split("ReadSchema")[1]


@pytest.mark.parametrize("content,want", [
    (b"a" * 2000 + b"\xff", True), (b"a" * 1023 + b"\xff", False), (b"a" * 1024 + b"\xff", True),
    ("é".encode() * 1024 + b"\xff", True), ("😀".encode() * 1024, True), ("😀".encode() * 1030, True), (b"", True), (b"\xc3", False)])
def test_is_text(spark, content, want):
    df = spark.createDataFrame([(bytearray(content),)], "content binary")
    assert df.select(corpus.is_text(F.col("content"))).first()[0] is want


@pytest.mark.parametrize("path,want", [
    ("a/b.PY", ".py"), ("a.b/c", ""), (".env", ""), ("x/.env", ""), ("a.tar.gz", ".gz"), ("..a.py", ".py"), ("a.", "."), ("", "")])
def test_extension(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(tx.extension(F.col("p"))).first()[0] == want


def test_filters(spark, tree):
    files = corpus.read_corpus(spark, tree)
    assert names(select.supported_files(files, [".js"]), tree) == ["node_modules/m.js", "src/web.js"]
    kept = names(select.env_files(files), tree)
    assert "conf/prod.env" in kept and "conf/.env" in kept and "requirements.txt" not in kept
    assert "node_modules/m.js" not in names(select.exclude_dirs_files(files), tree)
    assert names(select.exclude_paths(files, r"\.py$|\.js$"), tree) == ["conf/.env", "conf/prod.env", "requirements.txt"]


def test_env_secrets(spark, tree):
    rows = secrets.env_secrets(corpus.read_corpus(spark, tree, glob="*.env")).collect()
    got = sorted((r["key"], r["line"], r["value_preview"], r["confidence"]) for r in rows)
    assert got == [("API_KEY", 5, "***", "High"), ("AUTHOR", 7, "12*45", "Medium"), ("DB_PASSWORD", 2, "ab**ef", "High"),
                   ("SECRET", 1, "**", "High"), ("TOKEN", 6, "****", "High")]


def test_pattern_scan(spark, tree):
    result = scan.pattern_scan(corpus.read_corpus(spark, tree), search_pattern="os", search_functions=["system"])
    found = {(r["file"].split("/proj/")[1], r["type"], r["severity"]) for r in result.findings.collect()}
    assert ("src/app.py", "Command Execution", "High") in found and ("src/bad.py", "Syntax Error", "Low") in found
    assert ("src/web.js", "Hard-coded Credentials", "High") in found
    app = [r for r in result.findings.collect() if r["file"].endswith("app.py") and r["type"] == "Command Execution"]
    assert {r["phase"] for r in app} == {"pattern", "call"}
    keys = {(r["file"].split("/proj/")[1], r["key"]) for r in result.secrets.collect()}
    assert {("conf/prod.env", "DB_PASSWORD"), ("conf/prod.env", "credentials"), ("src/app.py", "credentials")} <= keys
    totals = result.totals().first()
    assert totals["total_files"] == 11 and totals["total_findings"] == result.findings.count()
    assert {r["type"] for r in result.extra.collect()} == {"pattern_match", "function_match"}


def test_advanced_scan(spark, tree, tmp_path):
    result = scan.advanced_scan(corpus.read_corpus(spark, tree))
    rows = result.findings.collect()
    assert {r["phase"] for r in rows} == {"rule", "taint", "dependency", "query"}
    taint = [r for r in rows if r["phase"] == "taint"]
    assert [(r["line"], r["type"], r["code"]) for r in taint] == [(4, "Potential command_injection", "os.system(q)")]
    assert taint[0]["context"].startswith("q = request")
    sinks.write_report(str(tmp_path / "out"), result.findings, spark.createDataFrame([("f",)], "file string"), result.totals())
    back = spark.read.json(str(tmp_path / "out" / "findings"))
    assert back.count() == len(rows) and "scanned_at" in back.columns
    nodes, edges = graph.graph_nodes(result.findings), graph.graph_edges(result.findings)
    assert nodes.select("id").distinct().count() == nodes.count()
    assert edges.join(nodes, edges.target == nodes.id).count() == edges.count()


def test_rule_files(spark, tmp_path):
    yaml_text = "language: python\nrules:\n  - id: A\n    name: one\n    patterns:\n      - type: function_call\n        name: f\n" \
                "language: javascript\nrules:\n  - id: B\n    patterns:\n      - type: string_concat\n        with: SQL\n      - type: import\n        name: g\n"
    (tmp_path / "r.yaml").write_text(yaml_text)
    (tmp_path / "plain.yml").write_text("rules:\n  - id: C\n    patterns:\n      - {type: import, name: h, include_methods: false}\n")
    rows = catalogues.read_rules_yaml(spark, str(tmp_path)).orderBy("rule_id", "pattern_no").collect()
    assert [(r["language"], r["rule_id"], r["pattern_type"], r["applied"]) for r in rows] == [
        ("python", "A", "function_call", True), ("javascript", "B", "string_concat", False),
        ("javascript", "B", "import", False), ("common", "C", "import", True)]
    assert rows[0]["severity"] == "Medium" and rows[3]["include_methods"] is False
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "r.json").write_text(json.dumps({"language": "python", "rules": [{"id": "J", "patterns": [{"type": "import", "name": "q"}]}]}))
    assert [r["rule_id"] for r in catalogues.read_rules_json(spark, str(tmp_path / "j")).collect()] == ["J"]


def test_query_files(spark, tmp_path, files):
    (tmp_path / "mine.json").write_text(json.dumps({"name": "Mine", "language": "python", "pattern": "e.al"}))
    (tmp_path / "no.json").write_text(json.dumps({"name": "x", "language": "python"}))
    loaded, skipped = catalogues.read_queries(spark, str(tmp_path))
    assert [(r["id"], r["type"], r["severity"]) for r in loaded.collect()] == [("mine", "regex", "Medium")]
    assert [r["id"] for r in skipped.collect()] == ["no"]
    rows = search.run_all_queries(files({"a.py": "eval"}), loaded).collect()
    assert [(r["type"], r["severity"], r["query_id"]) for r in rows] == [("Custom Query: Mine", "Medium", "mine")]
    assert search.run_all_queries(files({"a.py": "eval"}), skipped).count() == 0
    (tmp_path / "mine.json").write_text(json.dumps(
        {"id": "t", "name": "T", "language": "python", "type": "ast", "pattern": "find dangerous_eval"}))
    loaded, _ = catalogues.read_queries(spark, str(tmp_path))
    rows = search.run_all_queries(files({"a.py": "eval (x)", "b.js": "eval(x)"}), loaded).collect()
    assert [(r["file"], r["code"], r["severity"]) for r in rows] == [("a.py", "eval (x)", "High")]


def test_false_positives_by_line(files):
    df = files({"a.txt": "# a@b.cc\nx@y.zz\nc@d.ee test f@g.hh\n"})
    rows = secrets.scan_sensitive(df).collect()
    assert sorted((r["line"], r["match"], r["probable_false_positive"]) for r in rows) == [
        (1, "a@b.cc", True), (2, "x@y.zz", False), (3, "c@d.ee", True), (3, "f@g.hh", True)]


def test_query_ids(spark):
    new = spark.createDataFrame([(i, "My Query", "p", "python") for i in range(5)] + [(9, "Weak-Crypto", "p", "python"), (10, "no pattern", None, "python")],
                                "seq long, name string, pattern string, language string")
    used = spark.createDataFrame([("my-query-1",), ("my-query-3",), ("weak-crypto",)], "id string")
    got = {r["seq"]: r["query_id"] for r in search.create_query_ids(new, used, chunk_size=2).collect()}
    assert got == {0: "my-query", 1: "my-query-2", 2: "my-query-4", 3: "my-query-5", 4: "my-query-6", 9: "weak-crypto-1"}


@pytest.mark.parametrize("kind,code,severity,confidence", [
    ("Command Execution", "x", "High", "Medium"), ("XSS", "x", "Medium", "Medium"), ("Other", "x", "Medium", "Medium"),
    ("User Input", "x", "Low", "Medium"), ("User Input", "token", "Medium", "Medium"), ("User Input", "token db", "High", "Medium"),
    ("User Input", "token db sudo", "High", "High"), ("Command Execution", "log", "Medium", "Medium"),
    ("Command Execution", "log mock", "Low", "Medium"), ("Command Execution", "log mock stub", "Low", "High"),
    ("SQL Injection", "%s", "Medium", "Medium"), ("SQL Injection", "%s +", "High", "Medium"), (None, None, "Medium", "Medium")])
def test_score(spark, kind, code, severity, confidence):
    df = spark.createDataFrame([(kind, code, "Critical")], "type string, code string, severity string")
    row = score.score_findings(df).first()
    assert (row["severity"], row["confidence"], row["rule_severity"]) == (severity, confidence, "Critical")


def test_explanation(spark):
    df = spark.createDataFrame([("SQL Injection", "cursor.Execute(a + b) # test", "High")], "type string, code string, severity string")
    assert score.score_findings(df).first()["explanation"] == (
        "The SQL Injection vulnerability is assessed as High severity. Risk factors: Contains high-risk keyword 'exec'; "
        "Contains high-risk keyword 'execute'. Mitigating factors: Contains low-risk context keyword 'test'. (AI assessment)")


def test_dedup_keeps_the_best(files):
    df = files({"a.py": "eval(x)\n" * 200})
    rows = score.score_findings(report.all_findings(search.pattern_findings(df), search.run_all_queries(df)))
    best = report.dedup_findings(rows).collect()
    assert len(best) == 400 and sum(r["n_merged"] for r in best) == rows.count()


def test_grouping_is_chunked(files):
    df = files({"a.txt": "x@y.zz\n" * 2500})
    rows = secrets.findings_by_file(secrets.scan_sensitive(df)).collect()
    assert sorted((r["chunk"], r["n"]) for r in rows) == [(0, 1000), (1, 1000), (2, 500)]


def test_stream(spark, files, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first, second = files({"a.py": "eval(x)\n"}), files({"b.js": "Math.random()\n"})
    for batch in (first, second):
        batch.select(*FILES.names).write.mode("append").parquet(source)
        stream = incremental.stream_findings(incremental.stream_files(spark, source))
        incremental.write_stream(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.parquet(out).select("file", "rule_id").collect()
    assert sorted(map(tuple, rows)) == [("a.py", "py-1"), ("b.js", "js-4")]


def test_account_of_files(spark, files):
    from codesift.operators import account

    df = files({"big.py": "x" * 50, "package.json": "{", "sub/pyproject.toml": "[a", "ok/package.json": "{}", "n.bin": None})
    got = {(r["path"], r["reason"]) for r in account.skipped_files(df, None, 40).collect()}
    assert got == {("big.py", "too large"), ("package.json", "manifest does not parse"),
                   ("sub/pyproject.toml", "manifest does not parse"), ("n.bin", "not text")}
    assert ("big.py", "too large") not in {(r["path"], r["reason"]) for r in account.skipped_files(df, None, None).collect()}
    twin = df.withColumn("file_id", F.col("file_id") % 4)
    assert sorted(r["path"] for r in account.colliding_ids(twin).collect()) == ["big.py", "n.bin"]


def test_tables_are_dropped(spark):
    from codesift import session

    held = session._written[:]
    session._written.clear()
    try:
        df = session.durable(spark.range(3).toDF("n"))
        assert df.count() == 3
        assert session.drop_tables(spark) == 1 and session.drop_tables(spark) == 0
    finally:
        session._written.extend(held)


def test_a_source_is_written_as_many_files(spark, tmp_path):
    from codesift.plans.checks.scans import _write_folders

    rows = [("a" if i % 3 else "b", i, "x" * 100) for i in range(600)]
    folder = tmp_path / "out"
    _write_folders(spark.createDataFrame(rows, "folder string, doc_id long, value string"), str(folder), file_bytes=2000, file_rows=50)
    files = list(folder.rglob("*.txt"))
    assert max(f.stat().st_size for f in files) <= 50 * 101 and len(files) >= 12
    assert sum(f.read_text().count("\n") for f in files) == 600


def test_generated_texts_are_made_by_all_cores(spark):
    from conftest import SF
    from codesift.sources import tables

    plan = tables.flow_files(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    made, read = plan.split("RepartitionByExpression")
    assert "AS text" in made and "AS text" not in read and "p_name" not in read.split("Relation")[0]

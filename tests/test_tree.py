"""Everything below a folder comes back, or says why not."""

import os

from pyspark.sql import functions as F

from codesift.operators import account
from codesift.sources import corpus, tree


def make(root):
    for name, content in {
        "a.py": b"x = 1\n", ".env": b"K=1\n", "_gen/__init__.py": b"", ".git/config": b"c", "deep/er/_x/.y": b"yy", "big.txt": b"z" * 3000, "bad.txt": b"\xff\xfe",
        "odd name/\xe9 #1%.txt": b"odd",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(root / "nowhere", root / "gone.py")   # cannot be read
    os.symlink(root, root / "deep" / "loop")          # a link to a folder is not followed
    return str(root)


def test_nothing_vanishes(spark, tmp_path):
    root = make(tmp_path / "t")
    for width, per_task in ((1, 5000), (3, 2), (1000, 1)):
        rows = tree.read_tree(spark, root, max_bytes=1000, width=width, files_per_task=per_task).collect()
        got = {r["path"].split("/t/")[1]: (r["length"], r["content"] and bytes(r["content"]), r["error"]) for r in rows}
        assert len(got) == len(rows)
        assert got.pop("gone.py")[1:] == (None, "FileNotFoundError")
        assert got == {
            "a.py": (6, b"x = 1\n", None), ".env": (4, b"K=1\n", None), "_gen/__init__.py": (0, b"", None), ".git/config": (1, b"c", None),
            "deep/er/_x/.y": (2, b"yy", None), "big.txt": (3000, None, "too large"), "bad.txt": (2, b"\xff\xfe", None), "odd name/\xe9 #1%.txt": (3, b"odd", None)}


def test_a_folder_that_cannot_be_listed(spark, tmp_path, monkeypatch):
    rows = tree.read_tree(spark, str(tmp_path / "none")).collect()
    assert [(r["error"], r["content"]) for r in rows] == [("FileNotFoundError", None)]
    # One that goes or is closed while the others are read.
    reader = tree._Reader({"path": f"file:{tmp_path}"})
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "f").write_bytes(b"1")
    real = tree.listed
    monkeypatch.setattr(tree, "listed", lambda uri: ([], [], "PermissionError") if uri.endswith("/shut") else real(uri))
    (tmp_path / "shut").mkdir()
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {(r["path"].rsplit("/", 1)[1], r["error"]) for r in found} == {("f", None), ("shut", "PermissionError")}


def test_corpus_with_errors(spark, tmp_path):
    root = make(tmp_path / "t")
    files = corpus.read_corpus_in_full(spark, root, 1000)
    assert files.count() == 9 and files.where("text IS NULL").count() == 2
    skipped = {(r["path"].split("/t/")[1], r["reason"]) for r in account.skipped_files(files).collect()}
    assert skipped == {("gone.py", "FileNotFoundError"), ("big.txt", "too large")}
    assert corpus.read_corpus(spark, root, 1000).count() == 7
    assert {r["path"].rsplit("/", 1)[1] for r in corpus.read_corpus(spark, root, None, glob="*.txt").collect()} == {"big.txt", "bad.txt", "\xe9 #1%.txt"}


def test_written_trees_come_back(spark, tmp_path):
    files = spark.createDataFrame([("a/.b", "one"), ("_c/d.py", "zwei\nÄ"), ("e", None)], "path string, text string").repartition(3)
    sizes = {r["path"]: r["length"] for r in tree.write_tree(files, str(tmp_path / "w")).collect()}
    assert sizes == {"a/.b": 3, "_c/d.py": 7, "e": 0}
    back = tree.read_tree(spark, str(tmp_path / "w")).select("path", F.col("content").cast("string").alias("text")).collect()
    assert {(r["path"].split("/w/")[1], r["text"]) for r in back} == {("a/.b", "one"), ("_c/d.py", "zwei\nÄ"), ("e", "")}

"""Manifest readers on awkward input, versions and advisories."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from codesift.functions.versions import is_affected, version_compare
from codesift.operators import deps
from codesift.sources import catalogues


def read(files, texts):
    return [
        (r["path"], r["name"], r["version"], r["version_constraint"], r["source"])
        for r in deps.read_dependencies(files(texts)).orderBy("path", "dep_no").collect()]


def test_requirements(files):
    text = "# c\n\n  a==1 # x\r\nb>=1,<2\nc\ngit+https://x\nhttps://y\nd ; python_version\ne[x]~=1\nf<=3\ng>2\nh<5\n"
    got = [r[1:4] for r in read(files, {"p/requirements.txt": text, "p/other.txt": text})]
    assert got == [("a", "1", "=="), ("b", "1,<2", ">="), ("c", "", ""), ("d", "", ""), ("e[x]", "1", "~="),
                   ("f", "3", "<="), ("g", "2", ">"), ("h", "5", "<")]


def test_broken_files_give_nothing(files):
    bad = "{ not json or toml ["
    names = ["pyproject.toml", "Pipfile", "Pipfile.lock", "package.json", "package-lock.json", "composer.json",
             "composer.lock", "project.json", "pom.xml", "build.gradle", "yarn.lock", "go.mod", "Gopkg.lock", "x.csproj"]
    assert read(files, {f"p/{n}": bad for n in names}) == []
    assert read(files, {"p/package.json": "[]", "q/package.json": "{}", "r/setup.py": "install_requires=[]"}) == []


def test_lock_versions(files):
    v1 = '{"dependencies": {"@s/a": {"version": "1"}, "b": {}}}'
    v2 = '{"packages": {"": {}, "node_modules/c": {"version": "2"}, "x/d@3": {"version": "4"}, "x/@e@5": {}}, "dependencies": {"z": {"version": "9"}}}'
    assert read(files, {"package-lock.json": v1, "q/npm-shrinkwrap.json": v2}) == [
        ("package-lock.json", "@s/a", "1", "==", "package-lock.json"), ("package-lock.json", "b", "", "==", "package-lock.json"),
        ("q/npm-shrinkwrap.json", "c", "2", "==", "npm-shrinkwrap.json"),
        ("q/npm-shrinkwrap.json", "@3", "4", "==", "npm-shrinkwrap.json"),
        ("q/npm-shrinkwrap.json", "@e", "5", "==", "npm-shrinkwrap.json")]


def test_go_blocks(files):
    text = "module m\nrequire a.b/c v1.0 // x\nrequire (\n  d.e/f v2.0 // indirect\n\n  require g.h/i v3.0\n)\nexclude j v1\nrequire (\n k/l v4\n"
    assert [r[1:3] for r in read(files, {"go.mod": text})] == [
        ("a.b/c", "1.0 // x"), ("g.h/i", "3.0"), ("d.e/f", "2.0"), ("k/l", "4")]


def test_gradle_and_xml(files):
    gradle = "dependencies {\n implementation 'a:b:1'\n implementation(\"c:d:2\")\n runtime \"e:f:3\"\n other 'x:y:1'\n}\n"
    pom = "<dependencies><dependency>\n<groupId>g</groupId><artifactId>a</artifactId>\n</dependency></dependencies><dependencies></dependencies>"
    assert [r[1:3] for r in read(files, {"build.gradle": gradle, "pom.xml": pom})] == [("a:b", "1"), ("e:f", "3"), ("g:a", "")]


def compare(a: str, b: str) -> int:
    x, y = (re.split("[.-]", v.strip().lstrip("v")) for v in (a, b))
    for p, q in itertools.zip_longest(x, y):
        if p is None or q is None:
            return -1 if p is None else 1
        if p.isdigit() and q.isdigit():
            p, q = int(p), int(q)
        if p != q:
            return -1 if p < q else 1
    return 0


def test_version_compare(spark):
    vs = ["2.19.1", "2.20.0", "v1.10", "1.9", "1.0", "1.0.0", "1.0-rc1", "1.0-rc2", "", "v", " 1.0 ", "01.0", "1.x", "1." + "9" * 40, "1.-2"]
    pairs = list(itertools.product(vs, vs))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", version_compare(F.col("a"), F.col("b")).alias("c"))
    for r in df.collect():
        assert r["c"] == compare(r["a"], r["b"]), r


@pytest.mark.parametrize("package,language,inside,outside", [
    ("requests", "python", ["2.19.1", "1.0", "", "v2.19"], ["2.19.2", "2.20.0", "2.19.1.1"]),
    ("urllib3", "python", ["1.24.1", "1.24"], ["1.24.2", "1.25"]),
    ("jinja2", "python", ["2.11.2"], ["2.11.3"]),
    ("jquery", "javascript", ["3.3.9"], ["3.4.0"]),
    ("lodash", "javascript", ["4.17.20"], ["4.17.21", "^4.0.0"]),
    ("org.apache.logging.log4j:log4j-core", "java", ["2.14.1", "2.15.0", "1.0"], []),
    ("symfony/security-http", "php", ["4.2.11", "4.3.7"], ["4.3.8"]),
    ("Newtonsoft.Json", "dotnet", ["12.0.2"], ["12.0.3"]),
    ("github.com/gin-gonic/gin", "go", ["1.5.9"], ["1.6.0"]),
    ("activesupport", "ruby", ["6.0.3"], ["6.0.4"]),
])
def test_advisory_bounds(spark, package, language, inside, outside):
    rows = [(1, "p", i, package, v, "==", language, "s") for i, v in enumerate(inside + outside)]
    df = spark.createDataFrame(rows, "file_id long, path string, dep_no int, name string, version string, version_constraint string, language string, source string")
    hits = deps.vulnerable_deps(df, catalogues.advisory_table(spark))
    assert sorted(r["version"] for r in hits.collect()) == sorted(inside)


def test_entry_forms(spark):
    cases = [("1.5", ["1.0-2.0"], True), ("2.5", ["1.0-2.0"], False), ("1.0-a", ["1.0-a"], True), ("1", ["a-b-c"], False), (None, [], True)]
    df = spark.createDataFrame(cases, "v string, affected array<string>, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", is_affected(F.col("v"), F.col("affected")).alias("got")).collect())
    both = spark.createDataFrame([("2.15.0", [">=2.0.0", "<=2.14.1"]), ("2.3.0", [">=2.0.0", "<=2.14.1"])], "v string, a array<string>")
    assert [r[0] for r in both.select(is_affected(F.col("v"), F.col("a"), "all")).collect()] == [False, True]


def test_first_of_equal_advisories(spark):
    rows = [(2, "b", 0, "requests", "1.0", "==", "python", "s"), (1, "a", 3, "requests", "1.0", "==", "python", "t")] * 50
    df = spark.createDataFrame(rows, "file_id long, path string, dep_no int, name string, version string, version_constraint string, language string, source string")
    unique = deps.dedup_advisories(deps.vulnerable_deps(df, catalogues.advisory_table(spark)))
    assert [(r["path"], r["source"]) for r in unique.collect()] == [("a", "t")]
    finding = deps.dependency_findings(unique).collect()[0]
    assert finding["mitigation"] == "Update requests to a version >= >=2.20.0" and finding["file"] == "DEPENDENCY"

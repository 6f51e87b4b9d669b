"""Reachability on any graph, and calls across files, against brute force."""

import random

import pytest

from codesift.operators import calls, facts as fx, reach


def brute_reach(edges, starts):
    seen, todo = set(starts), list(starts)
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    while todo:
        for b in after.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def chain(n, first=0):
    return [(first + i, first + i + 1) for i in range(n)]


@pytest.mark.parametrize("name", ["random", "chain", "cycle", "dead chain", "ladder", "empty"])
def test_reached(spark, name):
    rng = random.Random(9)
    edges, starts = {
        "random": ([(rng.randrange(60), rng.randrange(60)) for _ in range(90)] * 2, [0, 7, 99]),
        "chain": (chain(1000), [0]),
        # An entered cycle, one that nothing enters, and a loop.
        "cycle": (chain(999) + [(999, 0)] + chain(499, 2000) + [(2499, 2000), (5000, 5000), (-1, 500)], [-1]),
        # Every node of the chain also hangs on a chain that nothing reaches.
        "dead chain": (chain(100) + [(1000 + 10 * i + j, 1001 + 10 * i + j) for i in range(100) for j in range(8)] + [(1008 + 10 * i, i) for i in range(100)], [0]),
        "ladder": (chain(200) + [(i, i + 2) for i in range(199)], [0]),
        "empty": ([], [3]),
    }[name]
    rows = reach.reached(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s,) for s in starts], "node long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"] for r in rows} == brute_reach(edges, starts)


PROJECT = {
    "p/main.py": "from pkg import go\nfrom pkg.tools import helper as h\nimport pkg.deep.far\nimport solo as s\nfrom stars import *\n"
                 "def main():\n    go()\n    h(1)\n    pkg.deep.far.away()\n    s.alone()\n    shine()\n    bright.dim()\nmain()\n",
    "p/pkg/__init__.py": "from .impl import go\nfrom . import tools\n",
    "p/pkg/impl.py": "from .tools import inner\ndef go():\n    inner()\ndef unused():\n    go()\n",
    "p/pkg/tools.py": "def helper(x): return x\ndef inner():\n    from ..solo import alone\n    return 1\ndef never():\n    never()\n",
    "p/pkg/deep/far.py": "from ... import solo\nfrom ..tools import helper\ndef away():\n    solo.second()\ndef apart():\n    away()\n",
    "p/solo.py": "def alone():\n    pass\ndef second():\n    return third()\ndef third():\n    pass\ndef fourth():\n    third()\n",
    "p/stars.py": "from more import *\nfrom pkg import tools as bright\n",
    "p/more.py": "def shine():\n    gleam()\ndef gleam():\n    pass\ndef dull():\n    pass\n",
    "q/main.py": "from pkg import go\nimport os\nos.system('x')\ngo()\n",
    "q/src/pkg.py": "def go():\n    pass\ndef stay():\n    pass\n",
    "q/tests/check.py": "import pkg\npkg.stay()\n",
    "lone.py": "import missing\nmissing.go()\ndef f():\n    pass\n",
}


def test_calls_across_files(spark, files):
    rows = calls.unreachable_functions(fx.fact_table(files(PROJECT))).collect()
    got = {(r["path"], r["function"]) for r in rows}
    assert len(got) == len(rows)
    assert got == {
        ("p/pkg/impl.py", "unused"), ("p/pkg/tools.py", "never"), ("p/pkg/deep/far.py", "apart"), ("p/solo.py", "fourth"),
        ("p/more.py", "dull"), ("lone.py", "f")}


def test_modules_and_bindings(spark, files):
    facts = fx.fact_table(files({
        "a/x.py": "import y\nfrom y import f\nfrom .y import g\nfrom ..b import z as q\nfrom .... import n\nimport d.e\n",
        "a/y.py": "def f(): pass\n", "y.py": "def f(): pass\n", "b/z.py": "", "a/d/__init__.py": "", "a/d/e.py": "", "a/d.py": ""}))
    at = {r["module"]: r["file_id"] for r in calls.modules(facts).collect()}
    # A file without a fact is no module that anything could be called in.
    assert set(at) == {"a.x", "a.y", "y"}
    bound = {(r["bound"], r["to_file"], r["member"]) for r in calls.bindings(facts).collect()}
    assert bound == {("y", at["a.y"], None), ("f", at["a.y"], "f"), ("g", at["a.y"], "g")}


def test_a_file_without_imports_keeps_its_meaning(spark, files):
    rows = calls.unreachable_functions(fx.fact_table(files({
        "a.py": "def a():\n    b()\n    x = 1\ndef b():\n    a()\n    x = 1\ndef c():\n    self.d()\n    x = 1\ndef d():\n    pass\nc()\n",
        "b.py": "def a():\n    pass\n"}))).collect()
    assert {(r["path"], r["function"]) for r in rows} == {("a.py", "a"), ("a.py", "b"), ("b.py", "a")}

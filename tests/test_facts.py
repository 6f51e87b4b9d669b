"""Code facts against ``ast`` itself, and the structural rules."""

import ast

from pyspark.sql import functions as F

from codesift.operators import facts as fx, flow
from codesift.sources import catalogues

SOURCE = '''
import os, sys as s
from a.b import c as d, e
X = Y = os.path.join("p", f"{s}", *[1])

class Base(object, m.Meta):
    """Doc."""
    def go(self, n):
        if n:
            return self.helper(n).run(n)(1)
        x: int = 3
        def go(): pass
        return [open(k, mode="r", **kw) for k in n]

async def later():
    await go()
def go(a, *b): return lambda: eval("1" + a)
'''


def test_calls_as_ast_sees_them(files):
    df = files({"m.py": SOURCE, "n.js": "eval(x)", "bad.py": "def (", "nul.py": "x = '\x00'", "empty.py": ""})
    rows = fx.extract_facts(df).collect()
    assert {r["path"]: r["kind"] for r in rows if r["path"] != "m.py"} == {"bad.py": "syntax_error", "nul.py": "syntax_error"}
    m = [r for r in rows if r["path"] == "m.py"]
    assert [r["seq"] for r in m] == list(range(len(m)))

    def chain(f):
        if isinstance(f, ast.Name):
            return f.id
        if isinstance(f, ast.Attribute):
            inner = chain(f.value)
            return f"{inner}.{f.attr}" if inner else f.attr
        return None

    tree = ast.parse(SOURCE)
    want = sorted((chain(n.func), n.lineno, n.col_offset) for n in ast.walk(tree) if isinstance(n, ast.Call) and chain(n.func))
    assert sorted((r["name"], r["line"], r["col"]) for r in m if r["kind"] == "call") == want
    assert sum(r["kind"] == "string" for r in m) == sum(
        isinstance(n, ast.Constant) and isinstance(n.value, str) for n in ast.walk(tree))
    call = {r["name"]: r for r in m if r["kind"] == "call"}
    assert call["os.path.join"]["args"] == ["p", "JoinedStr", "Starred"] and call["os.path.join"]["is_formatted"]
    assert call["open"]["keywords"] == {"mode": "r"}
    assert call["run"]["rooted"] is False and call["self.helper"]["rooted"] is True
    assert [(r["name"], r["shadowed"], r["line"]) for r in m if r["kind"] == "function"] == [
        ("go", True, 8), ("go", True, 12), ("go", False, 17)]
    assert [r["name"] for r in m if r["kind"] == "assign"] == ["X", "Y"]
    assert [(r["module"], r["name"], r["asname"]) for r in m if r["kind"] == "import"] == [
        (None, "os", None), (None, "sys", "s"), ("a.b", "c", "d"), ("a.b", "e", None)]
    assert [r["bases"] for r in m if r["kind"] == "class"] == [["object", None]]


def test_odd_texts_do_not_stop_the_job(files):
    deep = "x = " + "(" * 500 + "1" + ")" * 500
    df = files({"a.py": "x = '\ud7ff'\n", "b.py": deep, "c.py": "s = '\\ud800'\nopen(s)", "d.py": "x = 1\ry = 2\n"})
    kinds = {r["path"] for r in fx.extract_facts(df).collect()}
    assert kinds == {"a.py", "b.py", "c.py", "d.py"}


def test_rules_and_options(spark, files):
    df = files({"a.py": "db.execute('%s' % x)\ndb.execute(q)\nexecute('{}'.format(x))\nimport random as r\nfrom random import randint\npassword = 1\n"})
    facts = fx.fact_table(df)
    rules = catalogues.rules_table(spark)
    assert sorted(r["line"] for r in fx.rule_calls(facts, rules).collect()) == [1, 3]
    no_methods = rules.withColumn("include_methods", F.lit(False))
    assert sorted(r["line"] for r in fx.rule_calls(facts, no_methods).collect()) == [3]
    assert sorted(r["line"] for r in fx.rule_imports(facts, rules).collect()) == [4, 5]
    found = fx.rule_assignments(facts, rules).collect()
    assert [(r["line"], r["rule_id"], r["code"]) for r in found] == [(6, "PY-HARDCODED-SECRET-001", "password = 1")]
    assert found[0]["context"] == "import random as r\nfrom random import randint\npassword = 1\n"
    skipped = fx.skipped_rules(rules).collect()
    assert {r["language"] for r in skipped} == {"javascript"}
    assert {"JS-EXEC-SQL-001", "JS-PROTO-POLLUTION-001", "JS-EVAL-001"} <= {r["rule_id"] for r in skipped}


def test_custom_rule_names_carry_context(spark, files):
    df = files({"a.py": "a = 1\nlib.zap(a)\nb = 2\n"})
    rules = spark.createDataFrame(
        [("python", [{"id": "Z", "name": "Zap", "patterns": [{"type": "function_call", "name": "zap"}]}])],
        catalogues.RULE_FILE_SCHEMA)
    rules = catalogues._one_row_per_pattern(rules)
    row = fx.rule_calls(fx.fact_table(df, fx.rule_names(rules)), rules).collect()[0]
    assert (row["line"], row["severity"], row["context"]) == (2, "Medium", "a = 1\nlib.zap(a)\nb = 2\n")


def test_bare_except_scopes(files):
    near = "try:\n  pass\nexcept:\n  pass\ndef f():\n  return 1\n"
    far = "def g():\n  a = 1\n  b = 2\n  try:\n    pass\n  except:\n    pass\n"
    mixed = "def h():\n  try:\n    pass\n  except Exception:\n    pass\n  except:\n    pass\n"
    facts = fx.fact_table(files({"near.py": near, "far.py": far, "mixed.py": mixed}))
    assert [r["file"] for r in flow.bare_except(facts).collect()] == ["far.py"]
    assert [r["file"] for r in flow.bare_except(facts, scope="context").collect()] == ["near.py"]


def test_interval_join_over_many_bins(files):
    body = "\n".join(f"    f{i}(x)" for i in range(400))
    text = f"def big(x):\n{body}\n    def small():\n        inner(x)\n        pass\n    return 1\n"
    facts = fx.fact_table(files({"a.py": text}))
    rows = flow.calls_in_function(facts).collect()
    assert sum(r["function"] == "big" for r in rows) == 401
    assert [(r["call"], r["line"]) for r in rows if r["function"] == "small"] == [("inner", 403)]
    edges = flow.flow_edges(flow.flow_nodes(facts)).collect()
    assert len([e for e in edges if e["function"] == "big"]) == 402


def test_children_are_those_of_ast_in_their_order():
    source = open(fx.__file__).read() + "\nmatch x:\n    case [1, *y, {'k': z}] if y: print(f'{z!r:>{w}}')\nasync def g(a, /, b: int = f(), *c, **d):\n    async with p() as q: [i async for i in q if i for j in r]\ntype T[U] = list[U]\n"
    facts = lambda children: [
        (type(n).__name__, n.lineno, n.col_offset) for n in walked(ast.parse(source), children) if type(n) in fx._FACTS_OF]

    def walked(tree, children):
        stack = [tree]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(list(children(node))))

    assert facts(fx._children) == facts(ast.iter_child_nodes) and len(facts(fx._children)) > 400

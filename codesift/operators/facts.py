"""Code facts of Python files and the structural rules on them.

Parsing is the one step that needs Python: one Arrow map over the files, row
by row, that emits flat fact rows.  All rules are joins and filters on them.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codesift.catalog.structural import DANGEROUS_CALLS, STRUCTURAL_RULE_ROWS
from codesift.catalog.taint import TAINT_SINKS
from codesift.functions import text as tx
from codesift.schemas import as_findings
from codesift.session import durable
from codesift.sources.catalogues import extension_of_language

# The parser helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACTS = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),      # function class call import assign string branch handler line syntax_error unparsed
    T.StructField("seq", T.IntegerType()),      # position in the source order of the file
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("keywords", T.MapType(T.StringType(), T.StringType())),
    T.StructField("module", T.StringType()),
    T.StructField("asname", T.StringType()),
    T.StructField("bases", T.ArrayType(T.StringType())),
    T.StructField("value_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("rooted", T.BooleanType()),   # a call name that starts at a plain name
    T.StructField("is_formatted", T.BooleanType()),
    T.StructField("shadowed", T.BooleanType()), # a later definition has the same name
    T.StructField("code", T.StringType()),      # the line, as written
    T.StructField("context", T.StringType()),   # two lines around, see context_names
    T.StructField("body", T.StringType()),      # lines of a function with an except:
])

_ARROW = pa.schema([
    ("file_id", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("seq", pa.int32()),
    ("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("col", pa.int32()),
    ("args", pa.list_(pa.string())), ("keywords", pa.map_(pa.string(), pa.string())),
    ("module", pa.string()), ("asname", pa.string()), ("bases", pa.list_(pa.string())),
    ("value_type", pa.string()), ("value", pa.string()), ("rooted", pa.bool_()),
    ("is_formatted", pa.bool_()), ("shadowed", pa.bool_()), ("code", pa.string()),
    ("context", pa.string()), ("body", pa.string()),
])
# Rows and bytes of text of one Arrow batch.
_BATCH = 2000
_BATCH_BYTES = 8 << 20
# A longer line is stored once, in a fact of kind "line", and not with each of
# its facts; ``with_lines`` puts it back.
INLINE = 2000


def _safe(value) -> str:
    """Text of a constant; lone surrogates cannot cross Arrow."""
    return str(value).encode("utf-8", "replace").decode("utf-8")


def _dotted(node: ast.expr) -> tuple[str | None, bool]:
    """Dotted name of a callee and whether it starts at a plain name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    rooted = isinstance(node, ast.Name)
    if rooted:
        parts.append(node.id)
    return (".".join(reversed(parts)) or None), rooted


def _short(node: ast.expr) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant):
        return _safe(node.value)
    return type(node).__name__


def _formatted(node: ast.expr) -> bool:
    if isinstance(node, ast.JoinedStr):
        return True
    if isinstance(node, ast.BinOp):
        return isinstance(node.op, (ast.Add, ast.Mod))
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format"


def _function(node: ast.FunctionDef) -> list[dict]:
    return [{"kind": "function", "name": node.name, "args": [a.arg for a in node.args.args],
             "value_type": getattr(node.returns, "id", None), "value": ast.get_docstring(node)}]


def _class(node: ast.ClassDef) -> list[dict]:
    return [{"kind": "class", "name": node.name, "bases": [getattr(b, "id", None) for b in node.bases],
             "value": ast.get_docstring(node)}]


def _call(node: ast.Call) -> list[dict]:
    name, rooted = _dotted(node.func)
    if not name:
        return []
    return [{"kind": "call", "name": name, "rooted": rooted, "args": [_short(a) for a in node.args],
             "keywords": [(k.arg, _short(k.value)) for k in node.keywords if k.arg is not None],
             "is_formatted": any(_formatted(a) for a in node.args)}]


def _assign(node: ast.Assign) -> list[dict]:
    value = _safe(node.value.value) if isinstance(node.value, ast.Constant) else None
    return [{"kind": "assign", "name": t.id, "value_type": type(node.value).__name__, "value": value}
            for t in node.targets if isinstance(t, ast.Name)]


def _import(node: ast.Import | ast.ImportFrom) -> list[dict]:
    dots = "." * (getattr(node, "level", 0) or 0)  # of a relative import
    return [{"kind": "import", "name": a.name, "asname": a.asname, "module": getattr(node, "module", None), "value": dots or None}
            for a in node.names]


def _constant(node: ast.Constant) -> list[dict]:
    return [{"kind": "string", "value": _safe(node.value)}] if isinstance(node.value, str) else []


def _branch(node: ast.If) -> list[dict]:
    return [{"kind": "branch", "name": "if"}]


def _handler(node: ast.ExceptHandler) -> list[dict]:
    return [{"kind": "handler", "value": _safe(f"except {ast.unparse(node.type)}:" if node.type else "except:")}]


_FACTS_OF = {
    ast.FunctionDef: _function, ast.ClassDef: _class, ast.Call: _call, ast.Assign: _assign,
    ast.Import: _import, ast.ImportFrom: _import, ast.Constant: _constant, ast.If: _branch,
    ast.ExceptHandler: _handler,
}


# Fields without a node that has facts or leads to one.
_PLAIN = {"ctx", "op", "ops", "id", "attr", "arg", "module", "level", "kind", "names", "type_comment", "conversion", "is_async", "simple"}
_FIELDS = {c: tuple(f for f in c._fields if f not in _PLAIN) for c in vars(ast).values()
           if isinstance(c, type) and issubclass(c, ast.AST) and c is not ast.Constant and getattr(c, "_fields", None)}


def _children(node: ast.AST) -> list[ast.AST]:
    """Child nodes in source order, as ``ast.iter_child_nodes`` has them, but
    for names, operators and the like."""
    out = []
    for field in _FIELDS.get(type(node), ()):
        value = getattr(node, field, None)
        if isinstance(value, list):
            out += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def context_names() -> frozenset[str]:
    """Last name parts of the calls, imports and variables that the built-in
    rules and sinks ask for; only such facts carry their context."""
    named = [p.get("name") or p.get("variable_name") for row in STRUCTURAL_RULE_ROWS for p in row[5]]
    named += [entry.rstrip("(") for entry in TAINT_SINKS]
    return frozenset(n.rsplit(".", 1)[-1] for n in named if n)


def file_facts(text: str, names: frozenset[str] = frozenset()) -> list[dict]:
    """Facts of one file in source order."""
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return [{"kind": "syntax_error", "seq": 0, "line": 0, "col": 0, "code": ""}]
    except (ValueError, RecursionError, MemoryError):
        return [{"kind": "unparsed", "seq": 0, "line": 0, "col": 0, "code": ""}]
    lines = text.split("\n")
    prefixes = tuple(names)
    out, newest, stack, long = [], {}, [tree], {}
    any_long = len(text) > INLINE and max(map(len, lines)) > INLINE

    def around(at: int) -> str:
        return "\n".join(lines[max(0, at - 3):at + 2])

    def place(fact: dict, at: int, near: bool) -> None:
        """The fact's line and, on request, the lines around it; long ones
        are left to the row of the line."""
        code = lines[at - 1] if at <= len(lines) else ""
        if any_long and any(len(x) > INLINE for x in (lines[max(0, at - 3):at + 2] if near else [code])):
            long[at] = long.get(at, False) or near
        else:
            fact["code"] = code
            if near:
                fact["context"] = around(at)

    while stack:
        node = stack.pop()
        build = _FACTS_OF.get(type(node))
        for fact in build(node) if build else ():
            at, kind, name = node.lineno, fact["kind"], fact.get("name")
            fact.update(seq=len(out), line=at, end_line=node.end_lineno, col=node.col_offset)
            near = kind == "handler"
            if kind in ("call", "import", "assign"):
                last, module = name.rsplit(".", 1)[-1], fact.get("module") or ""
                near = last in names or module.rsplit(".", 1)[-1] in names or name.startswith(prefixes)
            elif kind in ("function", "class"):
                if (kind, name) in newest:
                    newest[(kind, name)]["shadowed"] = True
                fact["shadowed"] = False
                newest[(kind, name)] = fact
                if kind == "function":
                    body = "\n".join(lines[at - 1:node.end_lineno])
                    if "except:" in body or "except:" in around(at):
                        fact["body"], near = body, True
            if kind not in ("string", "branch"):
                place(fact, at, near)
            out.append(fact)
        stack.extend(reversed(_children(node)))
    for at, near in sorted(long.items()):
        out.append({"kind": "line", "seq": len(out), "line": at, "code": lines[at - 1], "context": around(at) if near else None})
    return out


def extract_facts(files: DataFrame, names: frozenset[str] | None = None) -> DataFrame:
    """Fact rows of all Python files.

    Files stay where they are and leave the parser in small Arrow batches.
    The rows are kept lean for a large corpus: the two lines around a fact are
    added only where a rule or sink of ``names`` (the built-in ones by default)
    may report it, and a body only to functions with an ``except:``.
    """
    wanted = context_names() if names is None else names

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")  # the worker's own; odd escapes in parsed code warn
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for file_id, path, text in zip(*(batch.column(c) for c in ("file_id", "path", "text"))):
                for fact in file_facts(text.as_py() or "", wanted):
                    rows.append({"file_id": file_id.as_py(), "path": path.as_py(), **fact})
                    held += sum(len(fact.get(c) or "") for c in ("code", "context", "body", "value"))
                    if len(rows) >= _BATCH or held >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    python = files.where((tx.extension(F.col("path")) == ".py") & F.col("text").isNotNull())
    return python.select("file_id", "path", "text").mapInArrow(parse, FACTS)


def fact_table(files: DataFrame, names: frozenset[str] | None = None) -> DataFrame:
    """The facts, parsed once and sorted by kind inside each file written, so
    that a rule skips the row groups of other kinds and reads its columns only."""
    return durable(extract_facts(files, names).sortWithinPartitions("kind"))


def of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


def with_lines(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` of facts with the code and context of long lines filled in.
    Few lines are long, so the join is small."""
    long = of_kind(facts, "line").select("file_id", "line", F.col("code").alias("_code"), F.col("context").alias("_context"))
    return rows.join(long, ["file_id", "line"], "left").withColumns({
        "code": F.coalesce("code", "_code"), "context": F.coalesce("context", "_context")}).drop("_code", "_context")


def definitions(facts: DataFrame, kind: str = "function") -> DataFrame:
    """Definitions by name; the last one of a name counts."""
    return of_kind(facts, kind).where(~F.col("shadowed"))


def call_names(facts: DataFrame) -> DataFrame:
    return of_kind(facts, "call").select("file_id", "path", "line", "seq", "name", "rooted")


def _last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def rule_names(rules: DataFrame) -> frozenset[str]:
    """Names for ``extract_facts`` when other than the built-in rules run."""
    rows = rules.select(F.explode(F.array_compact(F.array("name", "variable_name"))).alias("n")).distinct()
    return context_names() | {r["n"].rsplit(".", 1)[-1] for r in rows.collect()}


def _python_rules(rules: DataFrame, pattern_type: str) -> DataFrame:
    here = extension_of_language(F.col("language")) == ".py"
    return rules.where(here & (F.col("pattern_type") == pattern_type))


def _rule_finding(rows: DataFrame, facts: DataFrame) -> DataFrame:
    return as_findings(
        with_lines(rows, facts), "rule", file=F.col("path"), match_no=F.col("seq"), type=F.col("rule_name"))


_RULE_LABELS = ("rule_id", "rule_name", "description", "severity", "mitigation")


def rule_calls(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls named by a rule, directly or as a method, with the formatted-text
    condition where the rule has one.  Joined on the last part of the name."""
    r = _python_rules(rules, "function_call").select(
        *_RULE_LABELS, F.col("name").alias("rule_call"), "with_string_formatting", "include_methods",
        _last_part(F.col("name")).alias("_last"))
    calls = of_kind(facts, "call").drop("severity", "description").withColumn("_last", _last_part(F.col("name")))
    same = (F.col("name") == F.col("rule_call")) | (
        F.col("include_methods") & F.col("name").endswith(F.concat(F.lit("."), F.col("rule_call"))))
    formatted = F.col("is_formatted") | F.exists("args", lambda a: a.rlike(r"%s|\{|\+"))
    return _rule_finding(
        calls.join(r, "_last").where(same & (~F.col("with_string_formatting") | formatted)), facts)


def rule_imports(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Imports whose name or module is the rule's: one equi join on either."""
    r = _python_rules(rules, "import").select(*_RULE_LABELS, F.col("name").alias("_key"))
    keys = of_kind(facts, "import").withColumn(
        "_key", F.explode(F.array_distinct(F.array_compact(F.array("name", "module")))))
    return _rule_finding(keys.join(r, "_key"), facts)


def rule_assignments(facts: DataFrame, rules: DataFrame) -> DataFrame:
    r = _python_rules(rules, "assignment").where(F.col("variable_name").isNotNull()).select(
        *_RULE_LABELS, F.col("variable_name").alias("_key"))
    return _rule_finding(of_kind(facts, "assign").withColumn("_key", F.col("name")).join(r, "_key"), facts)


def rule_exceptions(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Exception handlers whose head holds the text of a rule."""
    r = _python_rules(rules, "exception_handling").where(F.col("pattern").isNotNull()).select(
        *_RULE_LABELS, F.col("pattern").alias("_text"))
    # The texts are configuration: each head is tested against them in place.
    texts = sorted(row["_text"] for row in r.select("_text").distinct().collect())
    handlers = of_kind(facts, "handler").drop("severity", "description").withColumn(
        "_text", F.explode(F.filter(tx.text_array(texts or ["\0"]), lambda t: F.contains(F.col("value"), t))))
    return _rule_finding(handlers.join(r, "_text"), facts)


def skipped_rules(rules: DataFrame) -> DataFrame:
    """Rule patterns that no operator reads: of another type or language."""
    return rules.where(~F.col("applied")).select("language", "rule_id", "pattern_no", "pattern_type")


def dangerous_calls(facts: DataFrame) -> DataFrame:
    """Exact call names with a fixed type; the table is a literal map."""
    kinds = tx.text_map(DANGEROUS_CALLS)
    rows = of_kind(facts, "call").where(F.col("rooted")).withColumn("type", F.try_element_at(kinds, F.col("name")))
    return as_findings(
        with_lines(rows.where(F.col("type").isNotNull()), facts), "call",
        file=F.col("path"), match_no=F.col("seq"), rule_id=F.lit("dangerous-call"),
        severity=F.lit("Medium"), confidence=F.lit("Medium"), code=tx.strip(F.col("code")),
        description=F.concat(F.lit("Potentially dangerous function call: "), F.col("name")))


def user_input_calls(facts: DataFrame) -> DataFrame:
    rows = of_kind(facts, "call").where(F.col("rooted") & (F.col("name") == "input"))
    return as_findings(
        with_lines(rows, facts), "call", file=F.col("path"), match_no=F.col("seq"), rule_id=F.lit("user-input"),
        type=F.lit("User Input"), severity=F.lit("Low"), confidence=F.lit("Low"),
        code=tx.strip(F.col("code")), description=F.lit("Unvalidated user input from input() function"))


def unparsed_files(facts: DataFrame) -> DataFrame:
    """Files the parser gave up on for another reason than their syntax."""
    return of_kind(facts, "unparsed").select("file_id", "path")


def syntax_errors(facts: DataFrame) -> DataFrame:
    return as_findings(
        of_kind(facts, "syntax_error"), "call", file=F.col("path"), match_no=F.col("seq"),
        rule_id=F.lit("syntax-error"), type=F.lit("Syntax Error"), severity=F.lit("Low"),
        confidence=F.lit("High"), description=F.lit("Syntax error in Python file"))


INVENTORY_KINDS = ["function", "class", "call", "import", "assign", "string"]


def facts_inventory(facts: DataFrame) -> DataFrame:
    """Counts per file and kind; definitions of one name count once."""
    counted = facts.where(~F.coalesce("shadowed", F.lit(False)))
    wide = counted.groupBy("file_id", "path").pivot("kind", INVENTORY_KINDS).count()
    return wide.na.fill(0, INVENTORY_KINDS)

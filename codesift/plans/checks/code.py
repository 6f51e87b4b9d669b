"""Checks of code facts, data flow and control flow (A, T, C keys and N3).

The expected rows are stated per kind of generated file and joined to the part
keys, so the oracle needs no parser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.operators import calls, facts as fx, flow, reach, taint
from codesift.operators.ordering import next_in_groups, numbered_in_groups
from codesift.plans.checks.common import Check, values
from codesift.session import durable
from codesift.sources import catalogues, tables

_CODE_PATH = "'repo' || (p_partkey % 97)::VARCHAR || '/mod' || p_partkey::VARCHAR || '.py'"
_FLOW_PATH = "'repo' || (p_partkey % 97)::VARCHAR || '/app' || p_partkey::VARCHAR || '.py'"


def _code(s, d):
    return fx.fact_table(tables.code_files(s, d))


def _flow(s, d):
    return fx.fact_table(tables.flow_files(s, d))


def _expect(columns: list[str], code: list[tuple] = (), flow_: list[tuple] = (), select: str | None = None) -> str:
    """Rows per kind of file, for every part of that kind."""
    parts = []
    for rows, mod, path, name in ((code, len(tables.CODE_KINDS), _CODE_PATH, "c"), (flow_, len(tables.FLOW_KINDS), _FLOW_PATH, "f")):
        if rows:
            cols = select or ", ".join(columns)
            parts.append(f"(WITH {values(name, ['kind_no', *columns], list(rows))} SELECT p_partkey AS file_id, {path} AS path, {cols} "
                         f"FROM part JOIN {name} ON p_partkey % {mod} = kind_no)")
    return " UNION ALL ".join(parts)


def _tainted(s, d, which):
    f = which(s, d)
    return f, taint.taint_propagate(f)


def _hits(s, d, which, **more):
    f, t = _tainted(s, d, which)
    return taint.taint_to_sinks(f, t, **more)


def _traced(run, s, d, which):
    f, t = _tainted(s, d, which)
    return run(taint.taint_to_sinks(f, t), t)


def _both(run):
    """The same operator over both corpora."""
    return lambda s, d: run(_code(s, d)).unionByName(run(_flow(s, d)))


_FACT_COLUMNS = ["kind", "seq", "name", "line", "end_line", "value_type"]
_CODE_FACTS = [
    (0, "assign", 0, "x", 1, 1, "Constant"),
    (1, "import", 0, "hashlib", 1, 1, None), (1, "assign", 1, "h", 2, 2, "Call"), (1, "call", 2, "hashlib.md5", 2, 2, None),
    (2, "assign", 0, "q", 1, 1, "Call"), (2, "call", 1, "request.args.get", 1, 1, None), (2, "string", 2, None, 1, 1, None),
    (2, "assign", 3, "z", 2, 2, "Constant"), (2, "call", 4, "cursor.execute", 3, 3, None),
    (3, "assign", 0, "f", 1, 1, "Call"), (3, "call", 1, "open", 1, 1, None),
    (4, "assign", 0, "password", 1, 1, "Constant"), (4, "string", 1, None, 1, 1, None),
    (5, "syntax_error", 0, None, 0, None, None),
    (6, "assign", 0, "q", 1, 1, "Call"), (6, "call", 1, "request.args.get", 1, 1, None), (6, "string", 2, None, 1, 1, None),
    (6, "assign", 3, "z", 2, 2, "Constant"), (6, "assign", 4, "r", 3, 3, "Name"), (6, "assign", 5, "s", 4, 4, "Constant"),
    (6, "call", 6, "cursor.execute", 5, 5, None),
    (7, "function", 0, "f", 1, 5, None), (7, "handler", 1, None, 4, 5, None),
]
_FLOW_CALLS = [
    (0, "auth", 3), (0, "request.args.get", 4), (0, "os.system", 6), (0, "done", 7), (0, "load", 9),
    (1, "helper", 2), (1, "open", 5), (1, "inner", 8), (1, "inner", 10),
    (2, "request.form.get", 9), (2, "cursor.execute", 11), (2, "random.randint", 12),
    (3, "open", 3), (3, "f.read", 4), (3, "eval", 6),
    (4, "cursor.execute", 1), (4, "cursor.execute", 2), (4, "db.execute", 3), (4, "input", 4), (4, "eval", 5),
    (5, "pickle.loads", 5),
]
_CODE_CALLS = [(k, n, line) for k, kind, _s, n, line, _e, _v in _CODE_FACTS if kind == "call"]
_RULE_CALLS = {
    "code": [(1, "PY-WEAK-CRYPTO-001", "Medium", 2), (3, "PY-PATH-TRAVERSAL-001", "Medium", 1)],
    "flow": [(0, "PY-CMD-INJECTION-001", "High", 6), (1, "PY-PATH-TRAVERSAL-001", "Medium", 5),
             (2, "PY-INSECURE-RANDOM-001", "Medium", 12), (3, "PY-PATH-TRAVERSAL-001", "Medium", 3),
             (3, "PY-EVAL-EXEC-001", "High", 6), (4, "PY-SQL-INJECTION-001", "High", 1),
             (4, "PY-SQL-INJECTION-001", "High", 3), (4, "PY-EVAL-EXEC-001", "High", 5), (5, "PY-PICKLE-001", "High", 5)],
}
_RULE_COLUMNS = ["rule_id", "severity", "line"]


def _rule_check(run, code, flow_):
    def rows(s, d):
        rules = catalogues.rules_table(s)
        both = _code(s, d).unionByName(_flow(s, d))
        return run(both, rules).select("file_id", F.col("file").alias("path"), "rule_id", "severity", "line")

    return Check(rows, _expect(_RULE_COLUMNS, code, flow_))


def _inventory_sql() -> str:
    counts = {
        "c": [(0, 0, 0, 0, 0, 1, 0), (1, 0, 0, 1, 1, 1, 0), (2, 0, 0, 2, 0, 2, 1), (3, 0, 0, 1, 0, 1, 0), (4, 0, 0, 0, 0, 1, 1),
              (5, 0, 0, 0, 0, 0, 0), (6, 0, 0, 2, 0, 4, 1), (7, 1, 0, 0, 0, 0, 0)],
        "f": [(0, 1, 0, 5, 1, 2, 1), (1, 3, 0, 4, 0, 0, 0), (2, 1, 0, 3, 1, 5, 0), (3, 2, 1, 3, 0, 1, 1),
              (4, 0, 0, 5, 0, 1, 3), (5, 1, 0, 1, 2, 0, 0)],
    }
    cast = ", ".join(f'{k}_n::BIGINT AS "{k}"' for k in fx.INVENTORY_KINDS)
    return _expect([f"{k}_n" for k in fx.INVENTORY_KINDS], counts["c"], counts["f"], select=cast)


# Tainted variables: (kind, var, origin, parent, line, depth).
_TAINT_COLUMNS = ["var", "taint_type", "origin", "parent", "line", "depth"]
_TAINT_SELECT = "var, taint_type, origin, parent::VARCHAR AS parent, line, depth"
_CODE_TAINT = [
    (2, "q", "user_input", "request.args", None, 1, 0), (3, "f", "file_io", "open", None, 1, 0),
    (6, "q", "user_input", "request.args", None, 1, 0), (6, "r", "user_input", "request.args", "q", 3, 1)]
_FLOW_TAINT = [
    (0, "path", "user_input", "request.args", None, 4, 0), (2, "v", "user_input", "request.form", None, 8, 0),
    (2, "q", "user_input", "request.form", "v", 9, 1), (4, "value", "user_input", "input", None, 4, 0)]
_SINK_COLUMNS = ["line", "sink", "weakness", "severity", "tainted_variable", "origin"]
_SQL = ("sql_injection", "High")
_CODE_SINKS = [
    (2, 3, "execute", *_SQL, "q", "request.args"), (2, 3, "cursor.execute", *_SQL, "q", "request.args"),
    (6, 5, "execute", *_SQL, "r", "request.args"), (6, 5, "cursor.execute", *_SQL, "r", "request.args")]
_FLOW_SINKS = [
    (0, 6, "os.system", "command_injection", "High", "path", "request.args"),
    (2, 11, "execute", *_SQL, "q", "request.form"), (2, 11, "cursor.execute", *_SQL, "q", "request.form"),
    (4, 5, "eval", "code_execution", "High", "value", "input")]
_SELF_SINKS = [(3, 1, "open", "path_traversal", "Medium", "f", "open")]
_CHAINS = {
    ("c", 2): [("q", 1, "request.args"), ("sink", 3, "cursor.execute")],
    ("c", 6): [("q", 1, "request.args"), ("r", 3, "propagated from q"), ("sink", 5, "cursor.execute")],
    ("f", 0): [("path", 4, "request.args"), ("sink", 6, "os.system")],
    ("f", 2): [("v", 8, "request.form"), ("q", 9, "propagated from v"), ("sink", 11, "cursor.execute")],
    ("f", 4): [("value", 4, "input"), ("sink", 5, "eval")],
}


def _trace_rows(name: str, sinks: list[tuple], edges: bool) -> list[tuple]:
    out = []
    for k, _line, sink, *_rest in sinks:
        chain = _CHAINS[(name, k)]
        if edges:
            out += [(k, sink, i, f"{a[1]}:{a[0]}", f"{b[1]}:{b[0]}") for i, (a, b) in enumerate(zip(chain, chain[1:]))]
        else:
            out += [(k, sink, i, *step) for i, step in enumerate(chain)]
    return out


_MITIGATION = {
    "sql_injection": "Use parameterized queries or an ORM instead of string concatenation.",
    "command_injection": "Use library functions instead of shell commands. If shell commands are necessary, use shlex.quote() to sanitize inputs.",
    "code_execution": "Avoid using eval() or exec() with untrusted input. Use safer alternatives like ast.literal_eval() for parsing."}


def _finding_rows(sinks):
    return [(k, line, f"Potential {w}", sev, f"Tainted data from {origin} reaches dangerous sink {sink}", _MITIGATION[w])
            for k, line, sink, w, sev, _v, origin in sinks]


_INSIDE = [
    (0, "load", "auth", 3), (0, "load", "request.args.get", 4), (0, "load", "os.system", 6), (0, "load", "done", 7),
    (1, "inner", "helper", 2), (1, "helper", "open", 5), (1, "lost", "inner", 8),
    (2, "pick", "request.form.get", 9), (2, "pick", "cursor.execute", 11), (3, "get", "open", 3), (5, "read", "pickle.loads", 5)]
_FUNCTIONS = [(0, "load"), (1, "inner"), (1, "helper"), (1, "lost"), (2, "pick"), (3, "get"), (3, "run"), (5, "read")]


def _edge_rows() -> list[tuple]:
    out = []
    for k, function in _FUNCTIONS:
        chain = [f"ENTRY: {function}"] + [f"CALL: {c}" for kk, f, c, _l in _INSIDE if (kk, f) == (k, function)] + [f"EXIT: {function}"]
        out += [(k, function, a, b) for a, b in zip(chain, chain[1:])]
    return out


def _labelled_edges(s, d):
    nodes = durable(flow.flow_nodes(_flow(s, d)))
    edges = flow.flow_edges(nodes)
    label = nodes.select("node", "label")
    return (
        edges.join(label.select(F.col("node").alias("src"), F.col("label").alias("src_label")), "src")
        .join(label.select(F.col("node").alias("dst"), F.col("label").alias("dst_label")), "dst")
        .select("file_id", "function", "src_label", "dst_label", "type"))


# Function and depth of each finding of the structural rules.
_PLACED = [
    (0, "PY-CMD-INJECTION-001", 6, "load", 3), (1, "PY-PATH-TRAVERSAL-001", 5, "helper", 1),
    (2, "PY-INSECURE-RANDOM-001", 12, "pick", None), (3, "PY-PATH-TRAVERSAL-001", 3, "get", 1),
    (3, "PY-EVAL-EXEC-001", 6, "run", None), (4, "PY-SQL-INJECTION-001", 1, None, None),
    (4, "PY-SQL-INJECTION-001", 3, None, None), (4, "PY-EVAL-EXEC-001", 5, None, None), (5, "PY-PICKLE-001", 5, "read", 1)]


def _rule_findings(s, d):
    f = _flow(s, d)
    return f, durable(fx.rule_calls(f, catalogues.rules_table(s)))


def _event_nodes(s, d):
    return tables.table(s, d, "events").select("user_id", "ts", "event_id")


def _event_edges(s, d):
    """Each event to the next one of its user; a user's events are cut by day."""
    return next_in_groups(_event_nodes(s, d), ["user_id"], ["ts", "event_id"], F.date_trunc("day", F.col("ts")), "event_id")


def _event_depths(s, d):
    """Place of each event in the chain of its user."""
    day = F.date_trunc("day", F.col("ts"))
    rows = numbered_in_groups(_event_nodes(s, d), ["user_id"], ["ts", "event_id"], day, "k")
    return rows.select(F.col("event_id").alias("node"), (F.col("k") - 1).cast("int").alias("depth"))


def _event_reach(s, d):
    """Events that any steps lead to from the first of a user."""
    first = _event_nodes(s, d).groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("node"))
    return reach.reached(_event_edges(s, d), first)


def _event_reach_all(s, d):
    """The same with their depth, along chains."""
    nodes = _event_nodes(s, d)
    first = nodes.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("node")).select("node")
    return flow.reachable_in_chains(_event_edges(s, d), first)


# Files of ``linked_files`` with the next one of their chain.
_LINKS_SQL = f"""links AS (
  SELECT k, b, CASE WHEN k = last THEN b * {tables.CHAIN} ELSE k + 1 END AS n, b % {tables.ENTERED} = 0 AND k = b * {tables.CHAIN} AS entered
  FROM (SELECT p_partkey AS k, p_partkey // {tables.CHAIN} AS b,
          least((p_partkey // {tables.CHAIN} + 1) * {tables.CHAIN} - 1, max(p_partkey) OVER ()) AS last FROM part))"""


def _linked_graph(s, d):
    """Calls between functions of other files, by their names; names bound by an
    import are followed to what they stand for."""
    graph = durable(calls.call_graph(fx.fact_table(tables.linked_files(s, d))))
    graph = graph.where("src IS NOT NULL")
    bound = graph.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
    # A bound name is no function of its file: it has no definition.
    file_of = lambda c: F.split(c, ":")[0]
    defined = F.col("dst").rlike(r"^(\d+):[fg]\1$")
    through = graph.where(~defined).join(bound, "dst").select("src", F.col("end").alias("dst"))
    rows = graph.where(defined).unionByName(through).where(F.col("src").rlike(r"^(\d+):[fg]\1$"))
    return rows.select(file_of("src").cast("long").alias("src_file"), F.split("src", ":")[1].alias("caller"),
                       file_of("dst").cast("long").alias("dst_file"), F.split("dst", ":")[1].alias("callee"))


def _triage(s, d):
    f, t = _tainted(s, d, _flow)
    return flow.triage_difficulty(taint.taint_to_sinks(f, t), f).select(
        "file_id", "function", "sink", "tainted_variable", "line", "branches", "auth", "controlled", "difficulty")


def _strip_path(sql: str) -> str:
    return f"SELECT * EXCLUDE (path) FROM ({sql})"


CHECKS = {
    "extract_facts": Check(
        lambda s, d: _code(s, d).select("file_id", "path", *_FACT_COLUMNS), _expect(_FACT_COLUMNS, _CODE_FACTS)),
    "attribute_names": Check(
        _both(lambda f: fx.call_names(f).select("file_id", "path", "name", "line")), _expect(["name", "line"], _CODE_CALLS, _FLOW_CALLS)),
    "rule_calls": _rule_check(fx.rule_calls, _RULE_CALLS["code"], _RULE_CALLS["flow"]),
    "rule_calls_formatted": _rule_check(
        lambda f, r: fx.rule_calls(f, r.where("with_string_formatting")), [], [r for r in _RULE_CALLS["flow"] if "SQL" in r[1]]),
    "rule_imports": _rule_check(
        fx.rule_imports, [], [(2, "PY-INSECURE-RANDOM-001", "Medium", 1), (5, "PY-WEAK-CRYPTO-001", "Medium", 1)]),
    "rule_assignments": _rule_check(
        fx.rule_assignments, [(4, "PY-HARDCODED-SECRET-001", "High", 1)], [(3, "PY-HARDCODED-SECRET-001", "High", 7)]),
    "rule_exceptions": _rule_check(fx.rule_exceptions, [(7, "PY-BARE-EXCEPT-001", "Low", 4)], []),
    "dangerous_calls": Check(
        _both(lambda f: fx.dangerous_calls(f).select("file_id", F.col("file").alias("path"), "line", "type", "description", "code")),
        _expect(["line", "type", "description", "code"], [], [
            (0, 6, "Command Execution", "Potentially dangerous function call: os.system", "os.system(path)"),
            (3, 6, "Command Execution", "Potentially dangerous function call: eval", "return eval(s)"),
            (4, 5, "Command Execution", "Potentially dangerous function call: eval", "eval(value)"),
            (5, 5, "Deserialization", "Potentially dangerous function call: pickle.loads", "return pickle.loads(b)")])),
    "user_input_calls": Check(
        _both(lambda f: fx.user_input_calls(f).select("file_id", F.col("file").alias("path"), "line", "severity", "code")),
        _expect(["line", "severity", "code"], [], [(4, 4, "Low", "value = input()")])),
    "syntax_errors": Check(
        _both(lambda f: fx.syntax_errors(f).select("file_id", F.col("file").alias("path"), "line", "severity", "confidence", "type")),
        _expect(["line", "severity", "confidence", "type"], [(5, 0, "Low", "High", "Syntax Error")])),
    "facts_inventory": Check(_both(fx.facts_inventory), _inventory_sql()),
    "taint_sources": Check(
        _both(lambda f: taint.taint_sources(f).select("file_id", "path", *_TAINT_COLUMNS)),
        _expect(_TAINT_COLUMNS, [r for r in _CODE_TAINT if r[6] == 0], [r for r in _FLOW_TAINT if r[6] == 0], _TAINT_SELECT)),
    "taint_propagate": Check(
        _both(lambda f: taint.taint_propagate(f).select("file_id", "path", *_TAINT_COLUMNS)),
        _expect(_TAINT_COLUMNS, _CODE_TAINT, _FLOW_TAINT, _TAINT_SELECT)),
    "taint_to_sinks": Check(
        lambda s, d: _hits(s, d, _code).unionByName(_hits(s, d, _flow)).select("file_id", "path", *_SINK_COLUMNS),
        _expect(_SINK_COLUMNS, _CODE_SINKS, _FLOW_SINKS)),
    "taint_to_sinks_self_hits": Check(
        lambda s, d: _hits(s, d, _code, self_hits=True).select("file_id", "path", *_SINK_COLUMNS),
        _expect(_SINK_COLUMNS, _CODE_SINKS + _SELF_SINKS)),
    "taint_traces": Check(
        lambda s, d: _traced(taint.taint_traces, s, d, _code).unionByName(_traced(taint.taint_traces, s, d, _flow)).select(
            "file_id", "path", "sink", "step", "variable", "line", "source"),
        _expect(["sink", "step", "variable", "line", "source"], _trace_rows("c", _CODE_SINKS, False), _trace_rows("f", _FLOW_SINKS, False))),
    "mitigation_lookup": Check(
        lambda s, d: taint.taint_findings(_hits(s, d, _code).unionByName(_hits(s, d, _flow))).select(
            "file_id", F.col("file").alias("path"), "line", "type", "severity", "description", "mitigation"),
        _expect(["line", "type", "severity", "description", "mitigation"], _finding_rows(_CODE_SINKS), _finding_rows(_FLOW_SINKS))),
    "taint_origin": Check(
        _both(lambda f: taint.taint_origin(taint.taint_propagate(f))),
        _expect(["var", "origin", "depth"], [(r[0], r[1], r[3], r[6]) for r in _CODE_TAINT], [(r[0], r[1], r[3], r[6]) for r in _FLOW_TAINT])),
    "bare_except": Check(
        _both(lambda f: flow.bare_except(f).select("file_id", F.col("file").alias("path"), "line", "type", "severity")),
        _expect(["line", "type", "severity"], [(7, 1, "Bare except clause", "Medium")])),
    "unmanaged_open": Check(
        _both(lambda f: flow.unmanaged_open(f).select("file_id", F.col("file").alias("path"), "line", "type", "code")),
        _expect(["line", "type", "code"], [(3, 1, "Resource not properly managed", "f = open(p)")],
                [(1, 5, "Resource not properly managed", "    open(v)")])),
    "calls_in_function": Check(
        lambda s, d: flow.calls_in_function(_flow(s, d)).select("file_id", "path", "function", "call", "line"),
        _expect(["function", "call", "line"], [], _INSIDE)),
    "flow_edges": Check(
        _labelled_edges, _strip_path(_expect(["function", "src_label", "dst_label"], [], _edge_rows(), "function, src_label, dst_label, 'flow' AS type"))),
    "flow_edges_events": Check(
        _event_edges,
        "SELECT * FROM (SELECT user_id, event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL"),
    "finding_function": Check(
        lambda s, d: flow.finding_function(*reversed(_rule_findings(s, d))).select(
            "file_id", F.col("file").alias("path"), "rule_id", "line", "function"),
        _expect(["rule_id", "line", "function"], [], [r[:4] for r in _PLACED])),
    "reachable_findings": Check(
        lambda s, d: flow.reachable_findings(*reversed(_rule_findings(s, d))).select(
            "file_id", F.col("file").alias("path"), "rule_id", "line", "function", "depth", "reachable"),
        _expect(["rule_id", "line", "function", "depth"], [], _PLACED, "rule_id, line, function, depth, depth IS NOT NULL AS reachable")),
    "event_depths": Check(
        _event_depths,
        "SELECT event_id AS node, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS depth FROM events"),
    "reachable_events": Check(_event_reach, "SELECT event_id AS node FROM events"),
    "reachable_events_all": Check(
        _event_reach_all,
        "SELECT event_id AS node, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS depth FROM events"),
    "triage_difficulty": Check(
        _triage,
        _strip_path(_expect(["function", "sink", "tainted_variable", "line", "branches", "auth", "controlled", "difficulty"], [], [
            (0, "load", "os.system", "path", 6, 0, 1, 1, "Hard"),
            (2, "pick", "execute", "q", 11, 3, 0, 1, "Medium"), (2, "pick", "cursor.execute", "q", 11, 3, 0, 1, "Medium")],
            "function, sink, tainted_variable, line, branches::BIGINT AS branches, auth = 1 AS auth, controlled = 1 AS controlled, difficulty"))),
    "unreachable_functions": Check(
        _both(calls.unreachable_functions),
        _expect(["function", "line"], [(7, "f", 1)], [(1, "lost", 7), (2, "pick", 2), (3, "get", 2), (3, "run", 5), (5, "read", 3)])),
    "call_graph": Check(
        _linked_graph,
        f"""WITH {_LINKS_SQL}
        SELECT k AS src_file, 'f' || k AS caller, n AS dst_file, 'f' || n AS callee FROM links
        UNION ALL SELECT k, 'g' || k, k, 'f' || k FROM links"""),
    "unreachable_across_files": Check(
        lambda s, d: calls.unreachable_functions(fx.fact_table(tables.linked_files(s, d))).select("file_id", "path", "function", "line"),
        f"""WITH RECURSIVE {_LINKS_SQL},
        seen AS (SELECT k FROM links WHERE entered UNION SELECT n FROM links JOIN seen USING (k)),
        functions AS (
          SELECT k, b, 'f' || k AS function, 2 AS line FROM links WHERE k NOT IN (SELECT k FROM seen)
          UNION ALL SELECT k, b, 'g' || k, 4 FROM links)
        SELECT k AS file_id, 'repo/line/b' || b || '/m' || k || '.py' AS path, function, line FROM functions"""),
    "path_count": Check(
        _both(flow.path_count),
        _expect(["functions"], [(7, 1)], [(0, 1), (1, 3), (2, 1), (3, 2), (5, 1)], "functions::BIGINT AS functions")),
    "trace_edges": Check(
        lambda s, d: _traced(taint.trace_edges, s, d, _code).unionByName(_traced(taint.trace_edges, s, d, _flow)).select("file_id", "sink", "step", "source", "target", "type"),
        _strip_path(_expect(["sink", "step", "a", "b"], _trace_rows("c", _CODE_SINKS, True), _trace_rows("f", _FLOW_SINKS, True),
                            "sink, step, p_partkey::VARCHAR || ':' || a AS source, p_partkey::VARCHAR || ':' || b AS target, 'trace' AS type"))),
}

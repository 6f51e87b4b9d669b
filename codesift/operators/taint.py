"""Data flow: untrusted values from sources through assignments to sinks.

Joins are keyed by (file, variable) or (file, line).  What needs a whole file (the
closure, the steps to a sink) streams over partitions sorted by file: a file was
one text in one row, so its rows fit in a task, and very many small files cost no
call each.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codesift.catalog.taint import DEFAULT_MITIGATION, MITIGATIONS, SANITIZERS, TAINT_SINKS, TAINT_SOURCES
from codesift.functions import text as tx
from codesift.operators.facts import of_kind, with_lines
from codesift.schemas import as_findings
from codesift.session import durable

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

IDENTIFIER = r"(?dU)\b[^\W\d]\w*"
# Rows of an Arrow batch.
_BATCH = 5000


def file_by_file(rows: DataFrame, run: Callable[[int, list[tuple]], list[tuple]], schema: T.StructType) -> DataFrame:
    """``run(file_id, rows)`` for the rows (tuples without their first column,
    ``file_id``) of each file; gives rows of ``schema``."""
    arrow = to_arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        out: list[tuple] = []
        for file_id, group in itertools.groupby(flat, key=lambda r: r[0]):
            out += run(file_id, [r[1:] for r in group])
            if len(out) >= _BATCH:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.repartition("file_id").sortWithinPartitions("file_id").mapInArrow(stream, schema)


def _matching(table: list[dict]) -> Column:
    """Entries of a table that the call ``name`` starts with, or ends in after
    a dot; a trailing ``(`` of an entry is dropped, since call names have none."""
    rows = ", ".join(
        "named_struct(" + ", ".join(f"'{k}', {v if isinstance(v, int) else tx.sql_text(v)}" for k, v in row.items()) + ")"
        for row in table)
    return F.filter(
        F.expr(f"array({rows})"),
        lambda e: F.startswith(F.col("name"), e["entry"]) | F.endswith(F.col("name"), F.concat(F.lit("."), e["entry"])))


def taint_sources(facts: DataFrame, sources: dict[str, str] = TAINT_SOURCES) -> DataFrame:
    """Variables that take a value from a source.

    The first assignment within one line of the call is tainted.  A variable
    marked more than once keeps the last mark.
    """
    calls = of_kind(facts, "call").select(
        "file_id", "path", F.col("seq").alias("call_seq"), "line",
        F.explode_outer(_matching([
            {"no": i, "entry": s.rstrip("("), "taint_type": kind}
            for i, (s, kind) in enumerate(sources.items())])).alias("s"),
    ).where(F.col("s").isNotNull())
    near = calls.withColumn("line", F.explode(F.sequence(F.col("line") - 1, F.col("line") + 1)))
    # Of each line only the first assignment can be the first near a call.
    assigns = of_kind(facts, "assign").groupBy("file_id", "line").agg(
        F.min(F.struct(F.col("seq").alias("assign_seq"), F.col("name").alias("var"))).alias("f"))
    first = near.join(assigns, ["file_id", "line"]).groupBy("file_id", "path", "call_seq", "s").agg(
        F.min(F.struct("f.assign_seq", "f.var", "line")).alias("a"))
    marked = first.groupBy("file_id", "path", F.col("a.var").alias("var")).agg(
        F.max(F.struct("call_seq", F.col("s.no").alias("no"), F.col("s.taint_type").alias("taint_type"),
                       F.col("s.entry").alias("origin"), F.col("a.line").alias("line"))).alias("m"))
    return marked.select(
        "file_id", "path", "var", "m.taint_type", "m.origin",
        F.lit(None).cast("string").alias("parent"), "m.line", F.lit(0).alias("depth"))


def _lines(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The distinct lines of facts, each with its code once."""
    once = rows.groupBy("file_id", "line").agg(F.first("code", ignorenulls=True).alias("code"), F.lit(None).cast("string").alias("context"))
    return with_lines(once, facts).select("file_id", "line", "code")


def _names(code: Column, match: str) -> Column:
    """What a line is searched for: its identifiers, or its whole text."""
    if match == "identifier":
        return F.array_distinct(F.regexp_extract_all(code, F.lit(IDENTIFIER), F.lit(0)))
    return F.array(code)


def _uses(lines: list[tuple[int, list[str]]], known: set[str], match: str) -> dict[str, list[int]]:
    """Lines that name each of the known variables."""
    out: dict[str, list[int]] = {}
    if match == "identifier":
        for line, names in lines:
            for v in names or ():
                if v in known:
                    out.setdefault(v, []).append(line)
        return out
    search = ahocorasick.Automaton()
    for v in known:
        search.add_word(v, v)
    search.make_automaton()
    for line, (code,) in lines:
        for v in {v for _, v in search.iter(code or "")} if known else ():
            out.setdefault(v, []).append(line)
    return out


def _closure(rows: list[tuple], match: str) -> list[tuple]:
    """Tainted variables of one file, round by round.

    A round takes the variables marked last; a line that names one of them
    taints its targets not yet seen, the smallest (line, variable) first.  A
    target is looked at until it is seen, so the work is linear in the file.
    """
    sources, targets, lines = {}, {}, []
    for role, line, path, var, taint_type, origin, names in rows:
        if role == "source":
            sources[var] = (path, taint_type, origin, line)
        elif role == "assign":
            targets.setdefault(line, set()).add(var)
        else:
            lines.append((line, names))
    path = next(iter(sources.values()))[0] if sources else None
    uses = _uses(lines, set(sources).union(*targets.values()) if sources else set(), match)
    seen = {v: (v, taint_type, origin, None, line, 0) for v, (_, taint_type, origin, line) in sources.items()}
    frontier, depth = sorted(seen), 0
    while frontier:
        depth += 1
        # The two smallest variables per line: a variable does not taint itself.
        hit: dict[int, list[str]] = {}
        for v in frontier:  # in ascending order
            for line in uses.get(v, ()):
                if len(hit.setdefault(line, [])) < 2:
                    hit[line].append(v)
        best: dict[str, tuple[int, str]] = {}
        for line, by in hit.items():
            for t in targets.get(line, ()):
                parent = by[0] if by[0] != t else by[1] if len(by) > 1 else None
                if parent is not None and t not in seen and (t not in best or (line, parent) < best[t]):
                    best[t] = (line, parent)
        for t, (line, parent) in best.items():
            seen[t] = (t, seen[parent][1], seen[parent][2], parent, line, depth)
        for line in hit:
            targets[line] = {t for t in targets.get(line, ()) if t not in seen}
        frontier = sorted(best)
    return [(path, *r) for r in seen.values()]


_TAINTED = T.StructType([
    T.StructField("file_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("path", "var", "taint_type", "origin", "parent")],
    T.StructField("line", T.IntegerType()), T.StructField("depth", T.IntegerType())])


def taint_propagate(facts: DataFrame, tainted: DataFrame | None = None, match: str = "identifier") -> DataFrame:
    """Closure of the tainted variables over assignments, with the parent each
    was tainted by.

    Values do not leave their file, and a file was one text in one row, so each
    file is closed in one task, in one job however long its chains are.
    """
    sources = durable(tainted if tainted is not None else taint_sources(facts))
    assigns = of_kind(facts, "assign").join(sources.select("file_id").distinct(), "file_id", "left_semi")
    none = F.lit(None).cast("string")
    no_names = F.lit(None).cast("array<string>")

    def part(rows: DataFrame, role: str, **columns: Column) -> DataFrame:
        columns = {"path": none, "var": none, "taint_type": none, "origin": none, "names": no_names} | columns
        return rows.select("file_id", F.lit(role).alias("role"), "line", *[v.alias(k) for k, v in columns.items()])

    rows = part(sources, "source", **{c: F.col(c) for c in ("path", "var", "taint_type", "origin")}).unionByName(
        part(assigns.select("file_id", "line", "name").distinct(), "assign", var=F.col("name"))).unionByName(
        part(_lines(assigns, facts), "line", names=_names(F.col("code"), match)))
    return durable(file_by_file(rows, lambda file_id, held: [(file_id, *r) for r in _closure(held, match)], _TAINTED))


def mitigation_for(weakness: Column) -> Column:
    return F.coalesce(F.try_element_at(tx.text_map(MITIGATIONS), weakness), F.lit(DEFAULT_MITIGATION))


def taint_to_sinks(
    facts: DataFrame, tainted: DataFrame, self_hits: bool = False, match: str = "identifier",
    sinks: dict[str, tuple[str, str]] = TAINT_SINKS,
) -> DataFrame:
    """Sink calls whose line names a tainted variable and no sanitizer.

    ``self_hits`` also reports a variable on the line that taints it.
    """
    calls = durable(of_kind(facts, "call").select(
        "file_id", "path", "seq", "line", "col", "code", "context", F.col("name").alias("sink_call"),
        F.explode_outer(_matching([
            {"entry": s.rstrip("("), "weakness": weakness, "severity": severity}
            for s, (weakness, severity) in sinks.items()])).alias("k"),
    ).where(F.col("k").isNotNull()))
    lines = _lines(calls, facts).where(~tx.contains_any(F.col("code"), SANITIZERS))
    vars_ = tainted.select("file_id", "var", "origin", "taint_type", "depth", F.col("line").alias("taint_line"))
    # Which variables a line names is found once per line, not per call.
    named = _named(lines, vars_, match).join(vars_, ["file_id", "var"])
    hits = calls.join(named, ["file_id", "line"])
    if not self_hits:
        hits = hits.where(F.col("taint_line") != F.col("line"))
    return with_lines(hits, facts).select(
        "file_id", "path", "seq", "line", "col", "code", "context",
        F.col("k.entry").alias("sink"), "k.weakness", "k.severity", "sink_call",
        F.col("var").alias("tainted_variable"), "origin", "taint_type", "depth")


def _named(lines: DataFrame, vars_: DataFrame, match: str) -> DataFrame:
    """``file_id, line, var`` for the variables that lines name."""
    if match == "identifier":
        names = lines.select("file_id", "line", F.explode(_names(F.col("code"), match)).alias("var"))
        return names.join(vars_.select("file_id", "var"), ["file_id", "var"], "left_semi")
    both = lines.select("file_id", "line", "code", F.lit(None).cast("string").alias("var")).unionByName(
        vars_.select("file_id", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("code"), "var"))

    def find(file_id: int, rows: list[tuple]) -> list[tuple]:
        uses = _uses([(line, [code]) for line, code, var in rows if var is None], {var for _, _, var in rows if var is not None}, match)
        return [(file_id, line, v) for v, at in uses.items() for line in at]

    return file_by_file(both, find, _NAMED)


_NAMED = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("var", T.StringType())])


def taint_findings(hits: DataFrame) -> DataFrame:
    return as_findings(
        hits, "taint", file=F.col("path"), match_no=F.col("seq"),
        rule_id=F.concat_ws(":", F.lit("taint"), "sink", "tainted_variable"),
        type=F.concat(F.lit("Potential "), F.col("weakness")),
        description=F.concat(F.lit("Tainted data from "), F.col("origin"),
                             F.lit(" reaches dangerous sink "), F.col("sink")),
        mitigation=mitigation_for(F.col("weakness")))


_STEP = T.StructType([T.StructField("variable", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("source", T.StringType())])
_PATHS = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("tainted_variable", T.StringType()), T.StructField("steps", T.ArrayType(_STEP))])


def _paths(file_id: int, rows: list[tuple]) -> list[tuple]:
    """Steps from the origin to each wanted variable of one file."""
    by = {var: (parent, origin, line) for wanted, var, parent, origin, line in rows if not wanted}
    out = []
    for v in [r[1] for r in rows if r[0]]:
        chain, at = [], v
        while at in by:
            parent, origin, line = by[at]
            chain.append({"variable": at, "line": line, "source": origin if parent is None else f"propagated from {parent}"})
            at = parent
        out.append((file_id, v, chain[::-1]))
    return out


def _with_steps(hits: DataFrame, tainted: DataFrame) -> DataFrame:
    """``hits`` with all ``steps`` from the origin to the sink.  They are built
    from the parents, for the variables of hits only.  The hits are read three
    times, so they are written down."""
    hits = durable(hits)
    none = F.lit(None)
    wanted = hits.select("file_id", F.col("tainted_variable").alias("var")).distinct()
    held = tainted.join(wanted.select("file_id").distinct(), "file_id", "left_semi").select("file_id", F.lit(False).alias("wanted"), "var", "parent", "origin", "line")
    rows = held.unionByName(wanted.select(
        "file_id", F.lit(True).alias("wanted"), "var", none.cast("string").alias("parent"), none.cast("string").alias("origin"), none.cast("int").alias("line")))
    paths = file_by_file(rows, _paths, _PATHS)
    sink = F.struct(F.lit("sink").alias("variable"), F.col("line"), F.col("sink_call").alias("source"))
    return hits.join(paths, ["file_id", "tainted_variable"]).withColumn("steps", F.concat("steps", F.array(sink)))


def taint_traces(hits: DataFrame, tainted: DataFrame) -> DataFrame:
    """Ordered steps from the origin to the sink, one row per step."""
    return _with_steps(hits, tainted).select(
        "file_id", "path", "seq", "sink", "tainted_variable", "weakness", F.posexplode("steps").alias("step", "s"),
    ).select("file_id", "path", "seq", "sink", "tainted_variable", "weakness", "step",
             "s.variable", "s.line", "s.source")


def trace_edges(hits: DataFrame, tainted: DataFrame) -> DataFrame:
    """Edges between neighbouring steps of each trace, within the row."""
    pairs = tx.let(F.col("steps"), lambda s: F.transform(
        F.slice(s, F.lit(2), F.size(s) - 1),
        lambda b, i: F.struct(F.get(s, i).alias("a"), b.alias("b"), i.alias("i"))))
    node = lambda p: F.concat_ws(":", F.col("file_id").cast("string"), F.col(f"p.{p}.line").cast("string"), F.col(f"p.{p}.variable"))
    rows = _with_steps(hits, tainted)
    return rows.select("file_id", "path", "seq", "sink", "tainted_variable", F.explode(pairs).alias("p")).select(
        "file_id", "seq", "sink", "tainted_variable", F.col("p.i").alias("step"),
        node("a").alias("source"), node("b").alias("target"), F.lit("trace").alias("type"))


def taint_origin(tainted: DataFrame) -> DataFrame:
    return tainted.select("file_id", "path", "var", "origin", "depth")

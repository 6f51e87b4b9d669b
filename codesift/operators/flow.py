"""Control flow: functions, their calls in order, and what can be reached."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from codesift.operators.facts import definitions, of_kind, with_lines
from codesift.operators.ordering import next_in_groups, numbered_in_groups
from codesift.schemas import as_findings
from codesift.session import durable, durable_counted

# Lines per bin of the interval joins, and calls per chunk of a function.
BIN = 64
CHUNK = 1000


def line_bin(line: Column) -> Column:
    return F.floor(line / BIN)


def function_bins(facts: DataFrame) -> DataFrame:
    """Function ranges, one row per bin of lines they cover."""
    return definitions(facts).select(
        "file_id", F.col("name").alias("function"), F.col("line").alias("f_line"),
        F.col("end_line").alias("f_end"), F.col("col").alias("f_col"),
        F.explode(F.sequence(line_bin(F.col("line")), line_bin(F.col("end_line")))).alias("_bin"))


def bare_except(facts: DataFrame, scope: str = "function") -> DataFrame:
    """Functions with ``except:`` and no ``except Exception`` in their text, or,
    with ``scope='context'``, in the two lines around their definition."""
    text = F.col("body" if scope == "function" else "context")
    rows = with_lines(definitions(facts).where(F.col("body").isNotNull()), facts).where(
        F.contains(text, F.lit("except:")) & ~F.contains(text, F.lit("except Exception")))
    return as_findings(
        rows, "flow", file=F.col("path"), match_no=F.col("seq"), rule_id=F.lit("bare-except"),
        type=F.lit("Bare except clause"), severity=F.lit("Medium"), code=F.lit("except:"),
        description=F.concat(
            F.lit("Bare except clause in function "), F.col("name"),
            F.lit(". This will catch and suppress all exceptions, including SystemExit, KeyboardInterrupt, and MemoryError.")),
        mitigation=F.lit("Specify the exception types to catch, e.g., 'except Exception:' or more specific types."))


def unmanaged_open(facts: DataFrame) -> DataFrame:
    rows = with_lines(of_kind(facts, "call").where(F.col("name") == "open"), facts).where(~F.contains("code", F.lit("with ")))
    return as_findings(
        rows, "flow", file=F.col("path"), match_no=F.col("seq"), rule_id=F.lit("unmanaged-open"),
        type=F.lit("Resource not properly managed"), severity=F.lit("Medium"),
        description=F.lit("File opened without using a 'with' statement, which may lead to resource leaks if the file is not explicitly closed."),
        mitigation=F.lit("Use 'with open(...) as f:' to ensure the file is properly closed even if an exception occurs."))


def calls_in_function(facts: DataFrame) -> DataFrame:
    """Calls strictly inside the line range of a function.

    An interval join on (file, bin of lines): a call meets only the functions
    that cover its bin.
    """
    calls = of_kind(facts, "call").select(
        "file_id", "path", "seq", "line", "col", F.col("name").alias("call"), "args", line_bin(F.col("line")).alias("_bin"))
    inside = (F.col("f_line") < F.col("line")) & (F.col("line") < F.col("f_end"))
    return calls.join(function_bins(facts), ["file_id", "_bin"]).where(inside).select(
        "file_id", "path", "function", "seq", "line", "col", "call", "args")


def flow_nodes(facts: DataFrame) -> DataFrame:
    """ENTRY, the calls in order, and EXIT of every function."""
    def node_id() -> Column:
        return F.concat_ws(":", F.col("file_id").cast("string"), "function", "node_type", F.col("seq").cast("string")).alias("node")

    no_args = F.lit(None).cast("array<string>")
    ends = definitions(facts).select(
        "file_id", "path", F.col("name").alias("function"), "line", F.col("seq"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("pos"), F.lit("ENTRY").alias("node_type")),
            F.struct(F.lit(2).alias("pos"), F.lit("EXIT").alias("node_type")))).alias("e"),
    ).select("file_id", "path", "function", "line", "seq", "e.*",
             F.concat(F.col("e.node_type"), F.lit(": "), F.col("function")).alias("label"), no_args.alias("args"))
    calls = calls_in_function(facts).select(
        "file_id", "path", "function", "line", "seq", F.lit(1).alias("pos"), F.lit("CALL").alias("node_type"),
        F.concat(F.lit("CALL: "), F.col("call")).alias("label"), "args")
    nodes = ends.unionByName(calls)
    return nodes.select("*", node_id())


def _chunk() -> Column:
    """Chunks of a function's nodes that follow their order."""
    return F.col("pos") * 1_000_000 + F.floor(F.col("seq") / CHUNK)


def flow_edges(nodes: DataFrame) -> DataFrame:
    """Edges between neighbours in each function."""
    return next_in_groups(nodes, ["file_id", "function"], ["pos", "seq"], _chunk(), "node").withColumn(
        "type", F.lit("flow"))


def flow_depths(nodes: DataFrame) -> DataFrame:
    """Each node with its depth, the number of edges from its function's entry.

    The graph of a function is one chain, so the depth of a node is its place
    in the order, however long the chain.
    """
    rows = numbered_in_groups(nodes, ["file_id", "function"], ["pos", "seq"], _chunk(), "depth")
    return rows.withColumn("depth", (F.col("depth") - 1).cast("int"))


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes that edges lead to from a start, with the least depth.

    Breadth first: each round expands only nodes not seen before, so paths are
    never enumerated.  ``edges(src, dst)``, ``starts(node)``.  With
    ``max_depth`` nodes beyond it are left out.
    """
    edges = durable(edges.select("src", "dst"))
    frontier = durable(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = edges.join(frontier, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        frontier, n = durable_counted(
            step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if n == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def reachable_in_chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """As ``reachable``, where each node has at most one edge to it, in rounds
    that grow with the logarithm of the longest way: each node knows a node
    before it and how far that is, and takes over what that one knows."""
    starts = starts.select("node").distinct().withColumn("depth", F.lit(0))
    steps = edges.select(F.col("dst").alias("node"), F.col("src").alias("back")).join(starts, "node", "left_anti")
    todo, n = durable_counted(steps.withColumn("far", F.lit(1)))
    seen, most, reach = durable(starts), n, 1
    while n:
        known = seen.select(F.col("node").alias("back"), "depth")
        done = durable(todo.join(known, "back").select("node", (F.col("depth") + F.col("far")).cast("int").alias("depth")))
        seen = durable(seen.unionByName(done))
        # All ways of up to ``reach`` edges are known; what is left then goes round in a cycle.
        if reach > most:
            break
        left = todo.join(done.select("node"), "node", "left_anti")
        ahead = todo.select(F.col("node").alias("back"), F.col("back").alias("next"), F.col("far").alias("more"))
        todo, n = durable_counted(left.join(ahead, "back").select("node", F.col("next").alias("back"), (F.col("far") + F.col("more")).alias("far")))
        reach *= 2
    return seen


def finding_function(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """The smallest function around each finding; null outside of all."""
    keys = ["file_id", "phase", "rule_id", "match_no", "line"]
    rows = findings.withColumn("_bin", line_bin(F.col("line")))
    inside = (F.col("f_line") <= F.col("line")) & (F.col("line") <= F.col("f_end"))
    found = rows.join(function_bins(facts), ["file_id", "_bin"]).where(inside).groupBy(*keys).agg(
        F.min(F.struct((F.col("f_end") - F.col("f_line")).alias("size"), "f_line", "function", "f_end")).alias("f"))
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "f.function", "f.f_line", "f.f_end")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return findings.join(found, same, "left").drop(*[f"_{k}" for k in keys])


def reachable_findings(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Whether a node on the finding's line can be reached from the entry of
    its function, and at which depth."""
    nodes = flow_depths(flow_nodes(facts))
    at_line = nodes.groupBy("file_id", "function", "line").agg(F.min("depth").alias("depth"))
    placed = finding_function(findings, facts)
    return placed.join(at_line, ["file_id", "function", "line"], "left").withColumn(
        "reachable", F.col("depth").isNotNull())


def _on_the_way(targets: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the way to a target names authentication, and its variable.

    The way is all nodes of the function up to the target, so it is enough to
    know how deep the first node lies that does: one row per function, and one
    per function and variable.
    """
    on_way = F.concat_ws(" ", "label", F.concat_ws(" ", "args"))
    held = nodes.join(targets.select("file_id", "function").distinct(), ["file_id", "function"], "left_semi")
    auth = held.where(F.contains(on_way, F.lit("auth"))).groupBy("file_id", "function").agg(F.min("depth").alias("auth_depth"))
    wanted = targets.select("file_id", "function", "tainted_variable").distinct()
    named = held.join(wanted, ["file_id", "function"]).where(F.contains(on_way, F.col("tainted_variable"))).groupBy(
        "file_id", "function", "tainted_variable").agg(F.min("depth").alias("named_depth"))
    rows = targets.join(auth, ["file_id", "function"], "left").join(named, ["file_id", "function", "tainted_variable"], "left")
    before = lambda d: F.coalesce(F.col(d) <= F.col("end_depth"), F.lit(False))
    return rows.groupBy(*keys).agg(F.bool_or(before("auth_depth")).alias("auth"), F.bool_or(before("named_depth")).alias("controlled"))


def triage_difficulty(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Easy, Medium or Hard for each reachable taint finding, from the
    branches before it, words of authentication and the tainted variable on
    the way from the entry of its function."""
    keys = ["file_id", "function", "seq", "sink", "tainted_variable", "line"]
    nodes = durable(flow_depths(flow_nodes(facts)))
    # The path of a call is the nodes of its function up to itself.
    at = nodes.where(F.col("node_type") == "CALL").select(
        "file_id", "seq", "function", F.col("depth").alias("end_depth"))
    targets = hits.select("file_id", "seq", "sink", "tainted_variable", "line").join(at, ["file_id", "seq"])
    words = _on_the_way(targets, nodes, keys)
    ranges = function_bins(facts)
    branches = of_kind(facts, "branch").select("file_id", F.col("line").alias("b_line"), line_bin(F.col("line")).alias("_bin"))
    inside = branches.join(ranges, ["file_id", "_bin"]).where(
        (F.col("f_line") < F.col("b_line")) & (F.col("b_line") <= F.col("f_end")))
    # Branches up to the finding's line, counted along the lines of the function.
    marks = inside.select("file_id", "function", F.col("b_line").alias("line"), F.lit(1).alias("n")).unionByName(
        targets.select("file_id", "function", "line").distinct().withColumn("n", F.lit(0)))
    steps = marks.groupBy("file_id", "function", "line").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("file_id", "function").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    counts = steps.withColumn("branches", F.sum("n").over(along)).select("file_id", "function", "line", "branches")
    rows = words.join(counts, ["file_id", "function", "line"])
    n = F.col("branches")
    return rows.withColumn(
        "difficulty",
        F.when((n > 5) | (F.col("auth") & F.col("controlled")), "Hard")
        .when((n > 2) | F.col("auth") | F.col("controlled"), "Medium").otherwise("Easy"))


def path_count(facts: DataFrame) -> DataFrame:
    return definitions(facts).groupBy("file_id", "path").agg(F.count("*").alias("functions"))

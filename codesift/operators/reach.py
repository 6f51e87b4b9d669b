"""Nodes of a directed graph that a set of starts leads to, in few rounds.

Breadth first needs a round per edge of the longest way.  Here every node that
is not reached yet follows one of the edges to it back to another node, that one
to a next, and so on, by doubling: after k steps a node knows its ancestor 2^k
edges back along this choice.  If that ancestor is reached, so is the node.  A
chain or a cycle of any length therefore takes a number of steps that grows with
its logarithm.

Between rounds nodes that nothing can reach go, with their edges, so that no
node follows them back in vain: those without an edge to them, and those with
one edge only to a node that goes, or in a cycle of such nodes.  A round in
which no edge leaves the reached nodes is the last, so the result is exact on
every graph; choices only decide how many rounds it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codesift.session import durable, durable_counted


def _followed_back(picks: DataFrame, n: int) -> DataFrame:
    """``node, forced, end`` for picks ``node, back, hit, forced``: ``end`` is
    'reached', 'nothing' (an ancestor without edges to it) or null in a cycle;
    ``forced`` says that every node on the way has a single edge to it."""
    end = F.when(F.col("hit"), F.lit("reached"))
    rows = picks.select("node", F.when(~F.col("hit"), F.col("back")).alias("back"), "forced", end.alias("end"))
    done, open_ = None, durable(rows)
    steps = 0
    while True:
        ended = open_.where("end IS NOT NULL").select("node", "forced", "end")
        done = ended if done is None else done.unionByName(ended)
        if n == 0 or 1 << steps > 2 * n:
            break
        # Ends of earlier steps stay known to those that point at them.
        known = open_.select(F.col("node").alias("back"), F.col("back").alias("_back"), F.col("forced").alias("_forced"), F.col("end").alias("_end"))
        known = known.where("_end IS NULL").unionByName(done.select(
            F.col("node").alias("back"), F.lit(None).cast(dict(open_.dtypes)["back"]).alias("_back"),
            F.col("forced").alias("_forced"), F.col("end").alias("_end")))
        moved = open_.where("end IS NULL").join(known, "back", "left")
        lost = F.col("_forced").isNull()
        moved = moved.select(
            "node", F.when(F.col("_end").isNull() & ~lost, F.col("_back")).alias("back"),
            (F.col("forced") & F.coalesce("_forced", F.lit(True))).alias("forced"),
            F.when(lost, F.lit("nothing")).otherwise(F.col("_end")).alias("end"))
        open_, n_open = durable_counted(moved)
        steps += 1
        if n_open == 0:
            break
    left = open_.where("end IS NULL").select("node", "forced", "end")
    return done.unionByName(left)


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``node`` for all that ``edges(src, dst)`` lead to from ``starts(node)``,
    starts included.  Any graph: cycles, loops and repeated edges are fine."""
    starts = durable(starts.select("node").distinct())
    lit = starts.select(F.col("node").alias("src"), F.lit(True).alias("_lit"))
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    edges = edges.join(starts.select(F.col("node").alias("dst")), "dst", "left_anti")
    edges = durable(edges.join(lit, "src", "left").select("src", "dst", F.coalesce("_lit", F.lit(False)).alias("lit")))
    parts, seed = [starts], 0
    while True:
        picks, n = durable_counted(edges.groupBy(F.col("dst").alias("node")).agg(
            F.bool_or("lit").alias("hit"),
            F.min_by("src", F.xxhash64(F.lit(seed), "src")).alias("back"),
            (F.count("*") == 1).alias("forced")))
        if picks.where("hit").isEmpty():
            break
        ways = durable(_followed_back(picks, n))
        new = ways.where("end = 'reached'").select("node")
        parts.append(new)
        sources = edges.where(~F.col("lit")).select(F.col("src").alias("node")).distinct().join(picks.select("node"), "node", "left_anti")
        dead = ways.where("forced AND (end IS NULL OR end = 'nothing')").select("node").unionByName(sources)
        gone = new.unionByName(dead)
        edges = edges.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
        edges = edges.join(dead.select(F.col("node").alias("src")), "src", "left_anti")
        newly = new.select(F.col("node").alias("src"), F.lit(True).alias("_new"))
        edges = durable(edges.join(newly, "src", "left").select("src", "dst", (F.col("lit") | F.coalesce("_new", F.lit(False))).alias("lit")))
        seed += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

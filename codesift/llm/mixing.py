"""Mix sources to target weights by pivotal dependent rounding.

Each source gets a target number of words.  A document is copied
``target / source size`` times on average: the whole part is given to all,
the fraction is rounded by the pivotal method.  Two documents of nearly equal
size meet, mass moves at random from one to the other until one of them is
integral, and the other goes on with what is left.  Documents meet in leaves
of about 64; what is left of each leaf meets in the next level, and so on up
to one remainder per source.

Only DataFrame functions are used.  Every draw depends on the documents that
meet, so that reruns agree.

A row that repeats is one unit with its number n: of n times its fraction the
whole part is given to as many of them, and what is left is rounded like any
other unit, so a source made of one row many times meets its target too.

Defined cases: null texts have size 0; null sources are a source, the last in
order; rows equal in source, doc_id and size repeat each other, whatever their
texts, and differ by one copy at most; a source without words has target 0; ties
in size are ordered by a hash; a very long text is one row; an empty table gives
no rows; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codesift.llm.common import packed, table, uniform, word_count
from codesift.operators.ordering import numbered, numbered_in_groups
from codesift.session import durable, durable_counted

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
LEAF = 64
SEED = 7_919
# Repeats of one row that a task numbers.
REPEATS = 10_000


def source_targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """``source, source_size, target`` of each source of ``sizes(source, size)``.

    The excess of sources that reach ``most`` times their size is shared again
    among the others by weight until none is above.  A round reads one row.
    """
    totals = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = numbered(totals, [F.col("source").asc_nulls_last()], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = durable(ranked.withColumn(
        "weight", F.get(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))))
    cap = F.col("source_size") * F.lit(most)
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full_before = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        got = ranked.agg(
            F.count(F.when(full, 1)).alias("full"), F.sum(F.when(full, F.col("source_size"))).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if got["full"] == full_before or not got["open"]:
            break
        full_before = got["full"]
        level = max(0.0, budget - most * (got["held"] or 0)) / got["open"]
    target = F.when(F.col("weight") * F.lit(level) >= cap, cap).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def _unit(p: Column, of: Column) -> Column:
    return F.struct(*[of[n].alias(n) for n in ("size", "mix", "doc_id")], p.alias("p"))


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """One pivotal step: the unit carried so far meets the next."""
    a, c = acc["carry"]["p"], acc["carry"]
    b, s = x["p"], acc["carry"]["p"] + x["p"]
    draw = uniform(F.lit(seed), c["mix"], x["mix"])
    low = s < 1
    # Below one: the winner takes the sum, the other gets no copy.  Otherwise
    # the winner gets a whole copy and the other keeps what is over.
    first_wins = F.when(low, draw * s < a).otherwise(draw * (F.lit(2.0) - s) < F.lit(1.0) - b)
    stays = F.when(low == first_wins, c).otherwise(x)
    settled = F.when(low == first_wins, x).otherwise(c)
    left = F.when(low, s).otherwise(s - 1)
    left = F.when(F.abs(left) < 1e-9, F.lit(0.0)).when(F.abs(left - 1) < 1e-9, F.lit(1.0)).otherwise(left)
    done = _unit(F.when(low, F.lit(0.0)).otherwise(F.lit(1.0)), settled)
    return F.when(c.isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(
        F.struct(_unit(left, stays).alias("carry"), F.array_append(acc["done"], done).alias("done")))


def _fold(units: DataFrame, seed: int) -> DataFrame:
    """Let the units of each (source, leaf) meet, the largest first, so that
    what is left over in the end belongs to a small one."""
    unit = "struct<size:bigint,mix:bigint,doc_id:bigint,p:double>"
    start = F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(f"array<{unit}>").alias("done"))
    ordered = units.groupBy("source", "leaf").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
    met = F.aggregate("units", start, lambda acc, x: _meet(acc, x, seed))
    return durable(ordered.select("source", "leaf", met.alias("met")).select("source", "leaf", "met.carry", "met.done"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), source=F.col("source").cast("string"), size=word_count())
    dealt = durable(dealt_copies(durable(rows.select("doc_id", "source", "size")), **options)).where("base + extra > 0")
    same = (
        F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("r.source").eqNullSafe(F.col("t.source"))
        & (F.col("r.size") == F.col("t.size")))

    def held(some: DataFrame) -> DataFrame:
        return rows.alias("r").join(some.alias("t"), same)

    def copied(some: DataFrame) -> DataFrame:
        return some.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")

    once = copied(held(dealt.where("n = 1")).select("r.row", (F.col("t.base") + F.col("t.extra")).alias("copies")))
    many, n_many = durable_counted(dealt.where("n > 1"))
    if n_many == 0:
        return once  # no row repeats: the texts are joined once
    # Which of the repeats take one more is of no account; they are numbered by
    # a draw that is written down, in as many chunks as they need.
    key = ["doc_id", "source", "size"]
    again = held(many).select("r.*", "t.n", "t.base", "t.extra")
    again = durable(again.withColumn("_draw", F.rand(SEED)))
    chunk = F.floor(F.col("_draw") * F.ceil(F.col("n") / REPEATS)).cast("long")
    again = numbered_in_groups(again.withColumn("source", F.struct("source")).withColumn("doc_id", F.struct("doc_id")), key, ["_draw"], chunk, "_k")
    again = again.select("row", (F.col("base") + F.when(F.col("_k") <= F.col("extra"), 1).otherwise(0)).alias("copies"))
    return once.unionByName(copied(again))


def mixed(sizes: DataFrame, leaf: int = LEAF, seed: int = SEED, **targets) -> DataFrame:
    """Every row of ``sizes(doc_id, source, size)`` with source_size, target and
    its number of copies."""
    dealt = dealt_copies(sizes, leaf, seed, **targets)
    kinds = F.array(*[
        F.struct(copies.alias("copies"), times.alias("times"))
        for copies, times in ((F.col("base") + 1, F.col("extra")), (F.col("base"), F.col("n") - F.col("extra")))])
    rows = dealt.select("doc_id", "source", "size", "source_size", "target", F.inline(kinds)).where("times > 0")
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))
    many = rows.where(F.col("times") > REPEATS).select("*", F.explode(chunks).alias("_chunk")).repartition("doc_id", "_chunk")
    many = many.withColumn("times", F.least(F.col("times") - F.col("_chunk") * REPEATS, F.lit(REPEATS))).drop("_chunk")
    rows = rows.where(F.col("times") <= REPEATS).unionByName(many)
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_k", "times")


def _whole() -> Column:
    """How many of n rows surely take one copy more."""
    return F.when(F.col("n") == 1, F.lit(0).cast("long")).otherwise(F.floor(F.col("n") * F.col("part") + 1e-9).cast("long"))


def dealt_copies(sizes: DataFrame, leaf: int = LEAF, seed: int = SEED, **targets) -> DataFrame:
    """The distinct rows of ``sizes(doc_id, source, size)`` with their number n,
    source_size and target: each is copied ``base`` times, and ``extra`` of the n
    once more."""
    goals = durable(source_targets(sizes, **targets))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("base", F.floor(ratio).cast("long")).withColumn("part", ratio - F.col("base"))

    rows = durable(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    units = rows.withColumn("bin", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))
    # Leaves of a source follow the size: each bin has as many as it needs.
    bins = units.groupBy("source", "bin").agg(F.ceil(F.count("*") / leaf).alias("leaves"))
    before = Window.partitionBy("source").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("start", F.coalesce(F.sum("leaves").over(before), F.lit(0)))
    same_source = F.col("s.source").eqNullSafe(F.col("u.source"))
    units = (
        units.alias("u").join(bins.alias("s"), same_source & (F.col("s.bin") == F.col("u.bin")))
        .select("u.*", "leaves", "start").alias("u")
        .join(goals.alias("s"), same_source).select("u.*", "part"))
    mix = F.xxhash64(F.lit(seed), "doc_id", "size")
    units = units.withColumn("mix", mix).select(
        "source", (F.col("start") + F.pmod(F.col("mix"), F.col("leaves"))).alias("leaf"),
        F.struct("size", "mix", "doc_id", F.greatest(F.col("n") * F.col("part") - _whole(), F.lit(0.0)).alias("p")).alias("unit"))

    level, settled = _fold(units, seed), []
    while True:
        settled.append(level.select("source", F.explode("done").alias("unit")))
        seed += 1
        if not level.agg(F.max("leaf")).first()[0]:
            break
        level = _fold(level.select(
            "source", F.floor(F.col("leaf") / leaf).alias("leaf"), F.col("carry").alias("unit")), seed)
    # One remainder per source is left; a draw settles it.
    up = uniform(F.lit(seed), F.col("unit.mix")) < F.col("unit.p")
    last = F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))
    settled.append(level.select("source", F.col("carry").alias("unit")).withColumn(
        "unit", F.struct("unit.size", "unit.mix", "unit.doc_id", last.alias("p"))))
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionByName(more)
    extra = extra.select(
        F.col("source"), F.col("unit.doc_id").alias("doc_id"), F.col("unit.size").alias("size"),
        F.col("unit.p").cast("long").alias("extra"))

    same = same_source & F.col("s.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("s.size") == F.col("u.size"))
    out = rows.alias("u").join(extra.alias("s"), same).select("u.*", "s.extra").alias("u")
    out = out.join(goals.alias("s"), same_source).select("u.*", "source_size", "target", "base", "part")
    return out.withColumn("extra", F.col("extra") + _whole()).drop("part")


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    sizes = durable(docs)
    return mixed(sizes).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

"""Calls across files: modules of a corpus, names bound by imports, call graph.

A file is the module of its path (``a/b.py`` is ``a.b``, ``a/b/__init__.py`` too).
An absolute import is looked up below each folder above the importing file, the
nearest first, and below the ``ROOTS`` of each; a relative one below the folder
its dots name.  Every lookup is an equi join on the whole module name, so the
work grows with imports times folder depth, never with pairs of files.

A symbol is a file and a name.  Calls lead from a function to a symbol; a name
bound by ``from m import x`` leads on to the symbol x of m, so names passed on by
packages (``__init__.py``) need no resolution of their own: the graph is followed
through them.  A call whose name starts with no bound name is looked for among
the functions of its own file, by its last part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codesift.operators.facts import definitions, of_kind
from codesift.operators.flow import function_bins, line_bin
from codesift.operators.reach import reached
from codesift.session import durable, durable_counted

# Folders of sources beside the place a project is imported from.
ROOTS = ("", "src", "lib")


def _dotted(path: Column) -> Column:
    """``a/b/c.py`` as ``a.b.c``; a package is its folder."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(?i)\.py$", ""), r"(^|/)__init__$", "")
    return F.replace(F.regexp_replace(plain, "^/+", ""), F.lit("/"), F.lit("."))


def _folder(path: Column) -> Column:
    """Dotted folder of a file; empty at the top."""
    return F.replace(F.regexp_replace(F.regexp_extract(path, "^(.*)/", 1), "^/+", ""), F.lit("/"), F.lit("."))


def modules(facts: DataFrame) -> DataFrame:
    """``module, file_id``; of a package and a file of one name the package counts."""
    files = facts.select("file_id", "path").distinct()
    package = F.col("path").rlike(r"(^|/)__init__\.py$")
    return files.groupBy(_dotted(F.col("path")).alias("module")).agg(
        F.min(F.struct((~package).alias("plain"), "path", "file_id"))["file_id"].alias("file_id"))


def _joined(*parts: Column) -> Column:
    """Dotted name of the parts that are not empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ".")


def imports(facts: DataFrame) -> DataFrame:
    """One row per bound name: the file, the ``bound`` name as calls write it,
    the ``wanted`` module and, for ``from`` imports, the ``member`` of it; with
    the ``bases`` below which the module may lie, nearest first."""
    rows = of_kind(facts, "import").select(
        "file_id", "path", "name", "asname", F.coalesce("module", F.lit("")).alias("module"), F.length(F.coalesce("value", F.lit(""))).alias("level"),
        (F.col("module").isNotNull() | (F.length(F.coalesce("value", F.lit(""))) > 0)).alias("is_from"))
    folder = F.split(_folder(F.col("path")), r"\.")
    depth = F.when(_folder(F.col("path")) == "", 0).otherwise(F.size(folder))
    above = lambda k: F.array_join(F.slice(folder, 1, k), ".")
    # One dot is the folder of the file, each more the one above.
    relative = F.when(F.col("level") - 1 <= depth, F.array(above(F.greatest(depth - F.col("level") + 1, F.lit(0)))))
    tried = F.flatten(F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda k: F.transform(
        F.array(*[F.lit(r) for r in ROOTS]), lambda r: _joined(above(k), r))))
    return rows.select(
        "file_id", "is_from",
        F.coalesce("asname", "name").alias("bound"),
        F.when(F.col("is_from"), F.col("module")).otherwise(F.col("name")).alias("wanted"),
        F.when(F.col("is_from"), F.col("name")).alias("member"),
        F.when(F.col("level") > 0, relative).otherwise(tried).alias("bases")).where(F.col("bases").isNotNull())


def _resolved(rows: DataFrame, known: DataFrame, name: Column) -> DataFrame:
    """``rows`` with the file of the module ``name`` below the first base that has one."""
    keys = ["file_id", "bound", "member"]
    tried = rows.select("*", F.posexplode("bases").alias("_rank", "_base")).withColumn("module", _joined(F.col("_base"), name))
    found = tried.join(known.withColumnRenamed("file_id", "to_file"), "module")
    return found.groupBy(*keys).agg(F.min_by("to_file", "_rank").alias("to_file"))


def bindings(facts: DataFrame) -> DataFrame:
    """``file_id, bound, to_file, member``: names of a file that stand for a
    module of the corpus (``member`` null) or for a symbol of one; ``bound`` is
    ``*`` where all names of a module are bound."""
    rows, known = durable(imports(facts)), durable(modules(facts))
    whole = _resolved(rows.where("NOT is_from"), known, F.col("wanted"))
    inner = rows.where("is_from AND member <> '*'")
    # What is imported from a package is a module of it or a symbol in it.
    below = _resolved(inner, known, _joined(F.col("wanted"), F.col("member"))).withColumn("member", F.lit(None).cast("string"))
    symbol = _resolved(rows.where("is_from"), known, F.col("wanted"))
    symbol = symbol.withColumn("bound", F.when(F.col("member") == "*", "*").otherwise(F.col("bound")))
    return whole.unionByName(below).unionByName(symbol).distinct()


def _passed_on(bound: DataFrame, functions: DataFrame) -> DataFrame:
    """``file_id, bound, to_file, member`` of the names bound by ``*``: the
    functions and bound names of the module, through any number of such
    imports."""
    stars = durable(bound.where("bound = '*'").select("file_id", "to_file").where("file_id <> to_file").distinct())
    own = functions.select("file_id", "function").unionByName(
        bound.where("bound <> '*' AND member IS NOT NULL").select("file_id", F.col("bound").alias("function")))
    fresh, n = durable_counted(own.distinct())
    seen, out = fresh, None
    while n:
        step = stars.join(fresh.select(F.col("file_id").alias("to_file"), "function"), "to_file")
        links = durable(step.select("file_id", F.col("function").alias("bound"), "to_file", F.col("function").alias("member")).distinct())
        out = links if out is None else out.unionByName(links)
        fresh, n = durable_counted(links.select("file_id", F.col("bound").alias("function")).distinct().join(seen, ["file_id", "function"], "left_anti"))
        seen = seen.unionByName(fresh)
    return out if out is not None else bound.where("false")


def _symbol(file_id: str, name: str) -> Column:
    return F.concat_ws(":", F.col(file_id).cast("string"), F.col(name))


def _calls(facts: DataFrame) -> DataFrame:
    """``file_id, function, call, rooted``: every call with each function whose
    lines hold it, the last line included, or with none."""
    calls = of_kind(facts, "call").select("file_id", "seq", "line", "rooted", F.col("name").alias("call"), line_bin(F.col("line")).alias("_bin"))
    inside = (F.col("f_line") <= F.col("line")) & (F.col("line") <= F.col("f_end"))
    placed = calls.join(function_bins(facts), ["file_id", "_bin"]).where(inside).select("file_id", "seq", "function").distinct()
    return calls.join(placed, ["file_id", "seq"], "left").select("file_id", "function", "rooted", "call").distinct()


def call_graph(facts: DataFrame) -> DataFrame:
    """``src, dst`` between symbols of the whole corpus; ``src`` is null for
    calls at the top of a module."""
    functions = definitions(facts).select("file_id", F.col("name").alias("function"))
    bound = durable(bindings(facts))
    names = durable(bound.where("bound <> '*'").unionByName(_passed_on(bound, functions)).distinct())
    calls = durable(_calls(facts))
    caller = F.when(F.col("function").isNotNull(), _symbol("file_id", "function"))
    # In its own file: by the last part of the name.
    own = calls.withColumn("callee", F.substring_index("call", ".", -1))
    own = own.join(functions.select("file_id", F.col("function").alias("callee")), ["file_id", "callee"], "left_semi")
    own = own.select(caller.alias("src"), _symbol("file_id", "callee").alias("dst"))
    # Across files: the name, or what stands before its last part, is bound.
    by_name = calls.where("rooted").join(names.where("member IS NOT NULL").withColumnRenamed("bound", "call"), ["file_id", "call"])
    by_name = by_name.select(caller.alias("src"), _symbol("file_id", "call").alias("dst"))
    last = F.substring_index("call", ".", -1)
    before = F.expr("left(call, length(call) - length(substring_index(call, '.', -1)) - 1)")
    dotted = calls.where("rooted").withColumns({"bound": before, "callee": last}).where("bound <> ''")
    by_module = dotted.join(names.where("member IS NULL"), ["file_id", "bound"]).select(
        caller.alias("src"), _symbol("to_file", "callee").alias("dst"))
    # A bound name leads on to what it stands for.
    on = names.where("member IS NOT NULL").select(_symbol("file_id", "bound").alias("src"), _symbol("to_file", "member").alias("dst"))
    return own.unionByName(by_name).unionByName(by_module).unionByName(on).distinct()


def unreachable_functions(facts: DataFrame) -> DataFrame:
    """Functions that no chain of calls from the top of a module leads to,
    whichever files it passes."""
    graph = durable(call_graph(facts))
    starts = graph.where("src IS NULL").select(F.col("dst").alias("node"))
    seen = reached(graph.where("src IS NOT NULL"), starts)
    functions = definitions(facts).select("file_id", "path", F.col("name").alias("function"), "line")
    rows = functions.withColumn("node", _symbol("file_id", "function"))
    return rows.join(seen, "node", "left_anti").drop("node")

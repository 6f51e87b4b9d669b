"""Code facts by content: a text is parsed once, however many files hold it and
however many runs see it.

Vendored copies are most of a large corpus.  The store keeps the facts of a text
under its SHA-256, in one folder per run:

* ``facts/run=...``, fact rows with ``digest`` in place of file and path,
* ``parsed/run=...``, one row per text with the number of its facts, written last:
  a run counts only once this is there, so a run that dies in between leaves
  nothing that is read, and its texts are parsed by the next.

Facts depend on the names whose context they carry, so each set of names has a
store of its own.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codesift.functions import text as tx
from codesift.operators.facts import FACTS, context_names, extract_facts
from codesift.session import durable, path_exists

_STORED = T.StructType([T.StructField("digest", T.StringType())] + [f for f in FACTS if f.name not in ("file_id", "path")])
_PARSED = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_facts", T.LongType()), T.StructField("run", T.StringType())])
# Files that share a text and take their facts from one task.
SPLIT = 10_000


def digests(files: DataFrame) -> DataFrame:
    """``file_id, path, digest`` of the Python files, without their texts."""
    python = files.where((tx.extension(F.col("path")) == ".py") & F.col("text").isNotNull())
    return python.select("file_id", "path", F.sha2("text", 256).alias("digest"))


class FactStore:
    """The store below ``folder`` for one set of names."""

    def __init__(self, spark: SparkSession, folder: str, names: frozenset[str] | None = None) -> None:
        self.spark = spark
        self.names = context_names() if names is None else names
        kind = hashlib.sha256("\n".join(sorted(self.names)).encode()).hexdigest()[:16]
        self.folder = f"{folder}/names-{kind}"

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        if not path_exists(self.spark, f"{self.folder}/{part}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")

    def parsed(self) -> DataFrame:
        """``digest, n_facts, run`` of all texts the store knows."""
        return self._read("parsed", _PARSED)

    def facts(self) -> DataFrame:
        """Facts of the runs that were finished."""
        runs = [r["run"] for r in self.parsed().select("run").distinct().collect()]  # one per run
        rows = self._read("facts", T.StructType([*_STORED, T.StructField("run", T.StringType())]))
        return rows.where(F.col("run").isin(runs)).drop("run")

    def add(self, files: DataFrame) -> DataFrame:
        """Parse the texts the store does not know; ``file_id, path, digest`` of
        all Python files, for ``facts_of``."""
        lean = durable(digests(files))
        one = lean.groupBy("digest").agg(F.min(F.struct("path", "file_id")).alias("one"))
        new = durable(one.join(self.parsed().select("digest"), "digest", "left_anti").select("digest", "one.path", "one.file_id"))
        if new.isEmpty():
            return lean
        run = uuid.uuid4().hex
        texts = files.select("file_id", "path", "text").join(new, ["file_id", "path"])
        # The digest stands in for the path until the facts are stored.
        texts = texts.select("file_id", F.concat("digest", F.lit(".py")).alias("path"), "text")
        rows = extract_facts(texts, self.names).withColumn("digest", F.regexp_replace("path", r"\.py$", ""))
        rows.select(_STORED.names).sortWithinPartitions("kind").write.parquet(f"{self.folder}/facts/run={run}")
        counts = self.spark.read.schema(_STORED).parquet(f"{self.folder}/facts/run={run}").groupBy("digest").agg(F.count("*").alias("n_facts"))
        new.select("digest").join(counts, "digest", "left").select("digest", F.coalesce("n_facts", F.lit(0)).cast("long").alias("n_facts")).write.parquet(
            f"{self.folder}/parsed/run={run}")
        return lean

    def facts_of(self, lean: DataFrame) -> DataFrame:
        """Facts of ``lean(file_id, path, digest)`` in the shape of ``extract_facts``.

        A text with very many files is dealt to several tasks, each with a copy
        of its facts.
        """
        ways = lean.groupBy("digest").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("_ways"))
        salted = lean.join(ways, "digest").withColumn("_salt", F.pmod(F.xxhash64("path", "file_id"), F.col("_ways")).cast("int")).drop("_ways")
        facts = self.facts().join(ways, "digest").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).drop("_ways")
        return salted.join(facts, ["digest", "_salt"]).select(FACTS.names)


def stored_facts(files: DataFrame, folder: str, names: frozenset[str] | None = None) -> DataFrame:
    """As ``fact_table``, with the texts of ``folder``'s store parsed before."""
    store = FactStore(files.sparkSession, folder, names)
    return durable(store.facts_of(store.add(files)).sortWithinPartitions("kind"))

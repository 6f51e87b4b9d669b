"""Session set-up and durable cuts of the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codesift")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster it
    would be lost with its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="codesift-checkpoint-")
    sc.setCheckpointDir(folder)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted with the tables cut there."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# Folders of the tables cut by this driver, in the order they were written.
_written: list[str] = []


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables that ``durable`` has written so far, once their
    readers are done; returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a checkpoint and survives lost executors, but as a
    columnar table: later reads prune columns and row groups, and the optimizer
    knows the real size, so a small table is broadcast and a large one is not.
    """
    return durable_counted(df)[0]


def durable_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As ``durable``, with the number of rows, counted while writing."""
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


# A catalogue of at most this many rows is broadcast; it is counted where it is
# made, on the driver.
BROADCAST_ROWS = 10_000


def local_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A catalogue the driver holds anyway, broadcast when it is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df

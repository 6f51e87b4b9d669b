import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from codesift.session import local_session

    session = local_session(os.environ.get("BENCH_CPUS", "8"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    import oracle

    return oracle.connect(SF)


@pytest.fixture
def files(spark):
    """``files`` rows from {path: text}; ids follow the order of the paths."""
    from pyspark.sql import functions as F

    from codesift.functions import text as tx

    def make(texts: dict[str, str]):
        rows = [(i, p, t) for i, (p, t) in enumerate(texts.items())]
        df = spark.createDataFrame(rows, "file_id long, path string, text string")
        return df.withColumns({"ext": tx.extension(F.col("path")), "size": F.length("text").cast("long")})

    return make

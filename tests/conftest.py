import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
# Workers see the test modules only; the library must reach them by itself.
os.environ["PYTHONPATH"] = str(ROOT / "tests")

from interviewflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Values of an expression over a list of cells, in their order."""

    def run(expression, values, dtype="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {dtype}")
        return [r[0] for r in rows.select(expression(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]

    return run

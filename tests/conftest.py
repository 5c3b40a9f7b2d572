import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")


@pytest.fixture(scope="session")
def spark():
    from palimpsest.session import local_session

    s = local_session("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """The values of columns over a one-row table."""
    from pyspark.sql import functions as F

    def run(*cols):
        row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
        return row[0] if len(cols) == 1 else tuple(row)

    run.F = F
    return run

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["large", "salted"])
def strategy(request, monkeypatch):
    """Run a test with small lookup tables broadcast and brackets that first miss most cuts, and with every lookup join shuffled and salted."""
    from larkspool.operators import sampling, staging

    if request.param == "salted":
        monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(staging, "ROWS_PER_SALT", 20)
    else:
        monkeypatch.setattr(sampling, "SPREAD", 0.02)
    return request.param

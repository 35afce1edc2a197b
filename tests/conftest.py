import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Rounding ties and rare values show only in more rows.
QUERY_SF = os.environ.get("TEST_QUERY_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    own = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", f"{own}/local")
        .config("spark.checkpoint.dir", f"{own}/shared")
        .config("spark.sql.warehouse.dir", f"{own}/warehouse")
        .config("spark.driver.extraJavaOptions", f"-Dderby.system.home={own}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from tableloom.session import clear

    clear(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def query_sf():
    return QUERY_SF

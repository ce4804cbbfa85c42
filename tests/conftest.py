import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakemoor import Lake, build_session  # noqa: E402

SF_DIR = os.environ.get("LAKEMOOR_TEST_DATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "lakemoor-tests",
        master="local[8]",
        conf={
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def stored(spark, tmp_path):
    """A lake over a directory of tables ``customer``, ``Sources`` and ``it`` in one format."""
    root = tmp_path / "lh"
    spark.range(3).write.parquet(str(root / "customer"))
    spark.range(5).selectExpr("id", "concat('n', id) AS name").write.parquet(str(root / "Sources"))
    lake = Lake(spark)
    lake.add_database(str(root), name=f"Bronze_{tmp_path.name}")
    return lake, f"Bronze_{tmp_path.name}"

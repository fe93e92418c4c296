import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from quern.session import configure

    warehouse = tmp_path_factory.mktemp("warehouse")
    made = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(warehouse))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield configure(made)
    made.stop()


@pytest.fixture
def session(spark, tmp_path):
    from quern.session import Session

    made = Session(spark, str(tmp_path / "tables"), "ns")
    yield made
    made.stop()


@pytest.fixture
def plain(session):
    """The frame and table `plain`: nulls and a repeated key."""
    rows = [(1, "a", 10.0), (2, "b", 20.5), (3, "a", 30.25), (4, "c", None), (5, None, 50.0)]
    frame = session.createDataFrame(rows, "id bigint, vendor string, amount double")
    session.write(frame).saveAsTable("ns.plain")
    return frame


@pytest.fixture
def partitioned(session):
    """12 rows in three appends, one for each date; identity partition on the date."""
    for d, date in enumerate(("2026-08-15", "2026-08-16", "2026-08-17")):
        rows = [(4 * d + i, date, d * 10.0 + i) for i in range(4)]
        frame = session.createDataFrame(rows, "id bigint, as_at_date string, amount double").coalesce(1)
        session.write(frame).mode("append").partitionBy("as_at_date").saveAsTable("ns.partitioned")
    return session.table("ns.partitioned")

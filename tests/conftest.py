"""One session for all tests; its checkpoint folder stands for the folder that a cluster shares."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the test tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    """A value in a form in which both engines' results are equal."""
    import math

    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or type(value).__name__ in ("NAType", "NaTType") or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        return round(float(value), 7)
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


def same_rows(spark_frame, duck_frame) -> None:
    a, b = spark_frame.toPandas(), duck_frame
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted(repr([plain(v) for v in r]) for r in x[sorted(x.columns)].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)

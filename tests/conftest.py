from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Values as text, rows and columns in order, so that frames of two engines compare."""

    def text(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return str([text(x) for x in v])
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(round(float(v), 9))
        return str(v)

    columns = sorted(frame.columns)
    return frame[columns].astype(object).map(text).sort_values(columns).reset_index(drop=True)


@pytest.fixture(scope="session")
def same():
    def check(spark_frame, duck_frame):
        a, b = plain(spark_frame.toPandas()), plain(duck_frame.df())
        pd.testing.assert_frame_equal(a, b)

    return check

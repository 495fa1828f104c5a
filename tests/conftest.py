import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def _shown(x):
    if x is None or x is pd.NA or isinstance(x, float) and x != x:
        return "NULL"
    if isinstance(x, float):
        return f"{x:.6f}"
    return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)


def same_rows(df, sql_frame):
    assert sorted(df.columns) == sorted(sql_frame.columns)
    for c in df.columns:  # whole numbers beside nulls
        if pd.api.types.is_float_dtype(df[c]) and pd.api.types.is_integer_dtype(sql_frame[c]):
            df[c] = df[c].astype("Int64")
    frames = [sorted(tuple(_shown(x) for x in row) for row in f[sorted(f.columns)].itertuples(index=False)) for f in (df, sql_frame)]
    assert frames[0] == frames[1]


@pytest.fixture(scope="session")
def check_query(spark, duck):
    def check(name, f, sql):
        same_rows(f(spark, SF).toPandas(), duck.sql(sql).df())

    return check

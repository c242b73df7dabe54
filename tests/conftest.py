import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same_rows(got, expected):
    """Both DataFrame and DuckDB relation have the same columns and rows, in any order."""
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    a = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    at = [expected.columns.index(n) for n in names]
    b = sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
    assert a == b

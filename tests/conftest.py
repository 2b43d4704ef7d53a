import glob
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def same_rows(spark, folder, duck, query, sql):
    """The query's rows and those of its SQL, as sorted tuples by column name."""
    got = query(spark, folder)
    names = sorted(got.columns)
    left = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    cur = duck.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    right = sorted(tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall())
    assert len(left) == len(right)
    assert left == right

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from weftgraph import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat()
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    return round(float(v), 9) if isinstance(v, (int, float)) else str(v)


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted((tuple(map(plain, r)) for r in pdf[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_rows_equal_those_of_sql(spark, duck, name):
    assert rows(Q.queries()[name](spark, DIR).toPandas()) == rows(duck.execute(Q.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert Q.queries()[name](spark, DIR).count() > 0

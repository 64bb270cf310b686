"""Every query over the driver's tables against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

from kindred.plans import catalogue

DATA = os.environ.get("KINDRED_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.oracle_sql():
        assert rows
        return
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)


def test_listed_images_of_a_larger_table(spark):
    """More vectors than the smallest tables have."""
    import duckdb

    larger = os.path.join(os.path.dirname(DATA.rstrip("/")), "sf0.1")
    if not os.path.isdir(larger):
        pytest.skip("no larger tables")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{larger}/embeddings.parquet'")
    expected = con.execute(catalogue.oracle_sql()["listed_images"]).fetchall()
    got = catalogue.queries()["listed_images"](spark, larger).select("image_id", "relative_path", "position").collect()
    assert got and sorted(map(tuple, got)) == sorted(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns

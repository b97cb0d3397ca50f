"""Every query of the engine that has SQL, against DuckDB on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from kinspark.plans import registry

DATA = os.environ.get("KINSPARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, float):
            return round(x, 5) + 0.0
        return int(x) if hasattr(x, "__index__") else str(x)

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    if name not in ORACLE:
        assert got.limit(1).count() >= 0
        return
    want = duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)

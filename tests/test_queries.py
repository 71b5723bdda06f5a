"""Every registered query outside the text operators against its SQL, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import pytest

from pointloom import catalog_of_queries as C

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}" if v else "0"
    return str(v)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(C.queries()))
def test_query(spark, con, name):
    df = C.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    sql = C.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert Counter(tuple(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall()) == got

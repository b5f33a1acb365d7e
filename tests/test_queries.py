"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import decimal
import math
import os

import pytest

from tallgrass.plans.registry import ORACLES, QUERIES
from tallgrass.sources.hosts import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "NULL" if math.isnan(v) else f"{float(v):.9g}"
    return f"{v:.9g}" if isinstance(v, int) and abs(v) < 10**8 else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_sqls_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(ORACLES[name])
    own = [d[0] for d in r.description]
    assert sorted(own) == cols
    want = sorted(tuple(plain(row[own.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(plain(x) for x in row) for row in df.select(*cols).collect()) == want


def test_the_rest_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        QUERIES[name](spark, SF).count()

import duckdb
import pytest

from lodestar.plans.registry import ORACLES, QUERIES, expand
from lodestar.session import TABLES


def plain(v):
    return round(float(v), 6) if hasattr(v, "as_tuple") or isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    columns = sorted(got.columns)
    assert columns == sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert mine == theirs


def test_macros():
    assert expand("@set(f(a, ',')), @days(x, g(y))", 1) == "string_agg(DISTINCT CAST(f(a, ',') AS STRING), ',' ORDER BY CAST(f(a, ',') AS STRING)), CAST(date_diff('day', CAST(x AS DATE), CAST(g(y) AS DATE)) AS INT)"

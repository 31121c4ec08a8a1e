import duckdb
import pytest

from lodestar.llm.queries import ORACLES, QUERIES
from lodestar.session import TABLES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = QUERIES[name](spark, f"/root/testdata/{sf}")
    want = con.execute(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    names = [c[0] for c in want.description]
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    mine = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(mine, key=repr) == sorted(rows, key=repr)

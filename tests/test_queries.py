"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessera import plans
from tools.compare import TABLES, canon

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(SF, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    names, rows = want.columns, want.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(rows, names)

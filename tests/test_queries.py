"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from motionlake.jobs.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "events lineitem embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v if isinstance(v, (str, bool)) else round(float(v), 6)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names) and len(got) == len(want)
    assert all(a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-4)) for x, y in zip(a, b)) for a, b in zip(got, want))



"""Every registered query outside the training-data subpackage against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from spanlake.plans import bindings, streams  # noqa: F401

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = bindings.QUERIES[name](spark, str(DATA))
    if name not in bindings.ORACLES:
        assert got.count() >= 0
        return
    cursor = con.execute(bindings.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)

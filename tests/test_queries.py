"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from compare import TABLES, rows

from corpusloom.queries import load_all

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query(spark, database, name):
    q = load_all()[name]
    got = q.run(spark, FOLDER).toPandas()
    if q.sql is None:
        assert len(got) > 0
        return
    assert rows(got) == rows(database.execute(q.sql).fetchdf())

"""Every registered query that has SQL gives the same rows as DuckDB; the others run."""

import duckdb
import pytest

from lexweave.plans.queries import ORACLE, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got.columns)
        return
    want = oracle.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)

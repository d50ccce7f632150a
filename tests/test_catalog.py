"""Every registered graph query against its SQL form on the smallest tables."""

import os

import duckdb
import pytest

from codeweave.plans import catalog, state  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    return df.where(df.notna(), None).astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head(5).to_string()

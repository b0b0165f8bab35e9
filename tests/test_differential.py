"""Every query of the resolver against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from attestry import queries, queries_catalog, queries_identity, queries_ledger  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def canonical(df):
    def cell(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return "NULL"
        if "bool" in type(v).__name__:
            return str(bool(v))
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, row)) for row in df.itertuples(index=False)), list(df.columns)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sql, name):
    assert canonical(queries.QUERIES[name](spark, SF).toPandas()) == canonical(sql.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0

"""Every registered query of the reference's operators against its SQL oracle, at the smallest scale."""

import glob
import os

import duckdb
import pytest

import quillstone.plans.vault_catalog  # noqa: F401 - registers its queries
from quillstone.plans.catalog import ORACLES, QUERIES

DATA = os.environ.get("CATALOG_DATA", "/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in got.schema} == kinds
    rows = lambda df: sorted(map(str, df[cols].astype(str).values.tolist()))
    assert rows(got.toPandas()) == rows(want.df())

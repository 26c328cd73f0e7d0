"""The registered corpus queries on the smallest tables, against SQL where there is some."""

import glob
import os

import duckdb
import pytest

from strandweave.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, other, name):
    got = queries.QUERIES[name](spark, SF_DIR).toArrow().to_pandas()
    assert len(got) > 0
    if name in queries.ORACLES:
        want = other.sql(queries.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        pick = lambda x: x[columns].sort_values(columns).reset_index(drop=True)
        assert pick(got).equals(pick(want))

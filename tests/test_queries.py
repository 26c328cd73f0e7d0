"""Every registered query against its SQL statement on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, other, name):
    got = entry.queries()[name](spark, SF_DIR).toArrow().to_pandas()
    assert len(got) > 0
    if name not in entry.oracle_sql():
        return
    want = other.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got = got[columns].sort_values(columns).reset_index(drop=True)
    want = want[columns].sort_values(columns).reset_index(drop=True)
    assert got.dtypes.astype(str).tolist() == want.dtypes.astype(str).tolist()
    assert got.equals(want)


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["kmer", "cnt"]

"""Each query with SQL agrees with DuckDB over the small tables; the others run."""

import glob
import os

import pytest

from wordloom.plans import catalog

duckdb = pytest.importorskip("duckdb")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(norm(v[i]) for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    got = catalog.QUERIES[name](spark, data)
    if name not in catalog.ORACLES:
        assert got.count() >= 0
        return
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())

"""Each query of the library against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from cairn.plans import evaluation_queries, manifest_queries, more_queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


def rows(values):
    text = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows([[r[c] for c in columns] for r in df.collect()]) == rows([[r[i] for i in at] for r in want.fetchall()])

"""Every query of the catalog against its SQL on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from lodefall.plans import archive, catalog, indexes, intake, questions, records, rules, service, stored  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6g}")
    return str(value) if isinstance(value, datetime.date) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_agrees_with_sql(spark, sql, name):
    found = catalog.QUERIES[name](spark, DATA)
    cols = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in found.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert rows
        return
    there = sql.sql(catalog.ORACLES[name])
    assert sorted(there.columns) == cols
    at = [there.columns.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in there.fetchall()), key=repr)

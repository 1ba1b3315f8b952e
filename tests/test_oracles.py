"""Every registered query against its SQL in DuckDB, as sorted rows of equal columns."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from auditlake.plans import more  # noqa: F401
from auditlake.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        found.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return found


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert _sorted(got.columns, rows) == _sorted(names, found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_point(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 1
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())

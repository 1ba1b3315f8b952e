"""The queries of this subpackage that have SQL, against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from auditlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_matches_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    got = QUERIES[name](spark, folder).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(found.fetchall(), key=repr)

"""The corpus queries that SQL can express, against it, on small tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from siftwarden.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(registry.ORACLES[name])
    assert columns == sorted(want.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.select(", ".join(columns)).fetchall())

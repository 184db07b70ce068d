"""Queries of the subpackage against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidewell.llm import oracle, queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for f in SF.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, str(SF))
    found = db.execute(oracle.SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in order) for r in found.fetchall())))


def test_every_sql_has_a_query():
    assert oracle.SQL.keys() <= queries.QUERIES.keys()

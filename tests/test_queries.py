"""Every query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidewell import oracle, queries

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    cell = lambda x: pd.Timestamp(x).tz_localize(None).isoformat() if hasattr(x, "isoformat") else str(round(x, 5) if isinstance(x, float) else x)
    return sorted(tuple(map(cell, r)) for r in rows)


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == oracle.SQL.keys()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    found = db.execute(oracle.SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[i] for i in order) for r in found.fetchall())


def test_csv_averages_at_a_rounding_tie(spark, tmp_path):
    """Sums in the order of the table and binary rounding: equal to the SQL on one thread, over rows that two tasks would add otherwise."""
    c = duckdb.connect()
    c.execute("SET threads = 1")
    # The rows of an hour lie far apart, its events have two decimals and its averages many ties; the last hour needs large numbers.
    c.execute(
        f"""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (i % 211) AS ts, 4 AS user_id, 'view' AS event_type,
        CASE WHEN i % 211 = 210 THEN 12345678.25 ELSE round((hash(i) % 50000) / 100, 2) END AS value, '{{"k": 1}}' AS props FROM range({211 * 40}) t(i)"""
    )
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        got = [r.line for r in queries.csv_export(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 211 and sorted(got) == sorted(r[0] for r in c.execute(oracle.SQL["csv_export"]).fetchall())

import os
import time
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from tidewell.operators import rollup
from tidewell.plans.store import Store
from tidewell.schema import POINT
from tidewell.sources import points as P
from tidewell.streaming import ingest

BASE = datetime(2024, 3, 1, 12, 0, tzinfo=UTC)


def batch(spark, name, rows, tenant="acme"):
    data = [(tenant, name, BASE, i, "m", "gauge", float(v), BASE + timedelta(seconds=s), {}) for i, (s, v) in enumerate(rows)]
    return spark.createDataFrame(data, POINT)


def test_redelivery_straddling_and_late_corrections(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    one = batch(spark, "b1", [(30, 10), (90, 20)])
    assert ingest.fold(store, one.union(one), 60, BASE) == {"acme": 1}
    assert ingest.fold(store, one, 60, BASE) == {"acme": 1}
    ingest.fold(store, batch(spark, "b2", [(31, 999)]).union(batch(spark, "b1", [(30, 10), (90, 20)], tenant="other")), 60, BASE)
    rows = sorted(store.rollups("acme").collect(), key=lambda r: r["window_start"])
    assert [(r["count"], r["sum"]) for r in rows] == [(2, 1009), (1, 20)] and store.rollups("other").count() == 2


def test_stream_into_store(spark, tmp_path):
    src, store = f"{tmp_path}/in", Store(spark, f"file://{tmp_path}/store")
    P.encode_envelopes(batch(spark, "b1", [(0, 1), (61, 2)])).select("envelope").coalesce(1).write.mode("append").text(src)

    def run():
        lines = spark.readStream.text(src).withColumnRenamed("value", "envelope")
        q = ingest.into_store(lines, store, f"{tmp_path}/bad", f"{tmp_path}/cp", clock=lambda: BASE).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(src)
    P.encode_envelopes(batch(spark, "b1", [(0, 1), (61, 2)]).union(batch(spark, "b3", [(5, 5)]))).select("envelope").coalesce(1).write.mode("append").text(src)
    run()
    rows = sorted(store.rollups("acme").collect(), key=lambda r: r["window_start"])
    assert [(r["count"], r["sum"]) for r in rows] == [(2, 6), (1, 2)]
    assert [r.fault for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["json"]
    direct = rollup.scalars(batch(spark, "x", [(0, 1), (61, 2), (5, 5)])).agg(F.sum("sum")).first()[0]
    assert direct == 8


def closed(spark, tmp_path, batches, name):
    """Sums of the windows that a stream of ``batches`` closes, by the minute they start in."""
    src = f"{tmp_path}/in"
    for i, rows in enumerate(batches):
        before = set(Path(src).glob("*.parquet"))
        batch(spark, f"b{i}", rows).coalesce(1).write.mode("append").parquet(src)
        for f in set(Path(src).glob("*.parquet")) - before:
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)  # files are taken by age
    stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    q = ingest.closed_windows(stream, 60, timedelta(seconds=30)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return {r.window_start.minute: r["sum"] for r in spark.table(name).collect()}


def test_watermark_closes_and_drops(spark, tmp_path):
    got = closed(spark, tmp_path, [[(0, 1)], [(200, 5)], [(201, 1)], [(10, 8)], [(400, 3)]], "closed")
    assert got[0] == 1.0 and got[3] == 6.0


def test_late_rows_right_behind_the_jump(spark, tmp_path):
    """They still count by default, and do not where a session has one watermark for late rows and for closing."""
    batches = [[(0, 1)], [(200, 5)], [(10, 8)], [(400, 3)]]
    assert closed(spark, tmp_path / "a", batches, "lagging")[0] == 9.0
    spark.conf.set(ingest.ONE_WATERMARK, "false")
    try:
        assert closed(spark, tmp_path / "b", batches, "strict")[0] == 1.0
    finally:
        spark.conf.unset(ingest.ONE_WATERMARK)


def test_idle_closes_only_the_oldest():
    t = ingest.Tumbling(60, 30)
    for at, v in ((0, 1.0), (70, 2.0), (130, 3.0)):
        t.add(at, v)
    assert t.watermark == 100 and t.close() == [(0, 1, 1.0)]
    t.idle()
    assert t.close() == [(60, 1, 2.0)] and sorted(t.open) == [120]
    t.add(61, 9.0)
    assert sorted(t.open) == [120]
    again = ingest.Tumbling(60, 30, t.state())
    again.idle()
    assert again.close() == [(120, 1, 3.0)] and again.state() == (180, [], [], [])


def test_idle_stream_runs(spark, tmp_path):
    """A timeout in processing time needs a trigger that goes on; ``availableNow`` would wait for it for ever."""
    batch(spark, "b", [(0, 1), (10, 2), (200, 5)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(POINT).parquet(f"{tmp_path}/in")
    q = ingest.idle_windows(stream, 60, timedelta(seconds=0), timedelta(seconds=1)).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.monotonic() + 90
        while time.monotonic() < until and spark.table("idle").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r["count"], r["sum"]) for r in spark.table("idle").orderBy("window_start").collect()] == [(2, 3.0), (1, 5.0)]

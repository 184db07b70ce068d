import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.functions import validate as V
from tidewell.operators import display, ledger, query, rollup
from tidewell.plans import request as R
from tidewell.plans.limits import Buckets
from tidewell.plans.store import Store
from tidewell.sources import points as P
from tidewell.streaming import ingest

BASE = datetime(2024, 3, 1, 12, 0, tzinfo=UTC)


def batch_file(folder, name, values):
    folder.mkdir(exist_ok=True)
    rows = [{"metric": "m", "kind": "gauge", "value": v, "timestamp": f"2024-03-01T12:00:0{i}Z", "labels": {"h": "1"}} for i, v in enumerate(values)]
    (folder / f"{name}.json").write_text(json.dumps({"batch_id": name, "points": rows}))


def test_batches_read_and_streamed(spark, tmp_path):
    batch_file(tmp_path / "in", "b1", [1.0, 2.0])
    batch_file(tmp_path / "in", "b2", [4.0])
    got = P.read_batches(spark, f"{tmp_path}/in", "acme", BASE)
    assert sorted((r.batch_id, r.idx, r.value) for r in got.collect()) == [("b1", 0, 1.0), ("b1", 1, 2.0), ("b2", 0, 4.0)]
    assert rollup.scalars(got).first()["last"] == 2.0
    q = P.stream_batches(spark, f"{tmp_path}/in", "acme").writeStream.format("memory").queryName("batches").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert q.awaitTermination(120)
    assert sorted((r.batch_id, r.value, r.tenant_id) for r in spark.table("batches").collect()) == [("b1", 1.0, "acme"), ("b1", 2.0, "acme"), ("b2", 4.0, "acme")]


def test_published_envelopes_reach_a_store(spark, tmp_path):
    batch_file(tmp_path / "in", "b1", [1.0, 2.0])
    points = P.read_batches(spark, f"{tmp_path}/in", "acme", BASE)
    P.publish(points, f"{tmp_path}/topic")
    P.publish(points, f"{tmp_path}/topic")
    store = Store(spark, f"file://{tmp_path}/store")
    q = ingest.into_store(P.subscribe(spark, f"{tmp_path}/topic"), store, f"{tmp_path}/bad", f"{tmp_path}/cp", clock=lambda: BASE).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r["count"], r["sum"]) for r in store.rollups("acme").collect()] == [(2, 3.0)]


def test_envelopes_of_a_writer_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_ENVELOPE_BYTES", 200)
    with pytest.raises(Exception, match="envelope too large"):
        P.encode_envelopes(P.pressure(spark, 10, BASE)).collect()


def test_generated_loads(spark):
    a, b = (P.random_load(spark, 500, BASE, seed=3) for _ in range(2))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.where("value < 5").isEmpty() and 1 <= a.where("value > 500").count() < 20 and a.select(F.element_at("labels", F.lit("host"))).distinct().count() == 10
    one = P.lineitem_as_points(spark, "/root/testdata/sf0.001")
    assert V.split(one)[1].isEmpty() and rollup.percentile(one, 86400, 0.5).where("v IS NULL").isEmpty()


def test_utf8_of_identities_and_labels(spark):
    row = spark.sql("SELECT cast(unhex('61FF') AS string) AS bad, 'aé' AS good")
    assert row.select(V.identity_ok(F.col("good")), V.identity_ok(F.col("bad"))).first()[:] == (True, False)


def test_answers_as_json(spark):
    p = P.pressure(spark, 30, BASE)
    req, bad = R.parse("pressure", {"metric": "load.value", "agg": "p95", "from": "2024-03-01T12:00:00Z", "to": "2024-03-01T13:00:00Z"}, BASE)
    doc = json.loads(query.answer_json(query.answer(rollup.build(p), req)))
    assert not bad and doc["kind"] == "mixed" and len(doc["series"]) == 10 and doc["warnings"] and not doc["truncated"]
    assert doc["series"][0]["points"][0][0] == "2024-03-01T12:00:00Z"
    with pytest.raises(ValueError):
        query.answer_json({"v": float("nan")})


def test_token_buckets():
    b = Buckets(rate=10, burst=100)
    assert b.take("a", 100, 0.0) == 0 and b.take("a", 20, 1.0) == 1.0 and b.take("a", 10, 1.0) == 0 and b.take("b", 100, 1.0) == 0
    assert b.take("a", 101, 50.0) == float("inf") and b.take("a", 1, 0.5) == 0.1
    assert b.forget(60.0) == 2 and not b.held
    with pytest.raises(ValueError):
        Buckets(0, 1)


def test_small_helpers(spark):
    assert [display.number_text(x) for x in (0, 1234.5, 12345, 2.5e6, 0.0001, 1e12)] == ["0", "1234.5", f"{12.345:.4g}K", "2.5M", "1.000e-04", "1.000e+12"]
    assert display.csv_text(["a", "b"]) == f"{display.CSV_HEADER}\r\na\r\nb"
    assert R.display_range("1h", BASE) == (BASE - timedelta(hours=1), BASE) and R.display_filters([("a", "b")]) == {"a": "b"}
    for bad in ([("a", "b"), ("a", "c")], [("__x", "")], [(f"k{i}", "") for i in range(21)]):
        with pytest.raises(ValueError):
            R.display_filters(bad)
    with pytest.raises(ValueError):
        R.display_range("custom", BASE, BASE, BASE - timedelta(hours=1))
    keys = spark.createDataFrame([("k-1",), ("",), ("é",), ("x" * 256,), ("a b",)], "k string").select(ledger.key_ok(F.col("k"))).collect()
    assert [r[0] for r in keys] == [True, False, False, False, False]
    held = spark.createDataFrame([(True, "x"), (False, "y")], "published boolean, batch string")
    assert [r.batch for r in ledger.completed(held).collect()] == [None, "y"]

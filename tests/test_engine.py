import math
import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from model import Acc, build, label_hash, slot
from tidewell.functions import histogram as H
from tidewell.functions import labels as L
from tidewell.functions import validate as V
from tidewell.functions.windows import end_of, start_of
from tidewell.operators import display, ledger, query, rollup
from tidewell.plans import request as R
from tidewell.plans.store import Conflict, Cursor, Store, next_cursor
from tidewell.schema import POINT
from tidewell.sources import points as P

BASE = datetime(2024, 3, 1, 12, 0, tzinfo=UTC)


def points(spark, rows, tenant="acme", batch="b"):
    """rows: (offset seconds, value, kind, labels)"""
    data = [(tenant, batch, BASE, i, "m", k, float(v), BASE + timedelta(seconds=s), lab) for i, (s, v, k, lab) in enumerate(rows)]
    return spark.createDataFrame(data, POINT)


def test_one_window(spark):
    r = rollup.build(points(spark, [(0, 10, "gauge", {}), (10, 30, "gauge", {}), (20, 20, "gauge", {})])).collect()
    assert [(x["count"], x["sum"], x["min"], x["max"], x["last"], x["buckets"]) for x in r] == [(3, 60, 10, 30, 20, None)]


def test_last_is_by_event_time_and_ties_take_the_larger(spark):
    r = rollup.scalars(points(spark, [(50, 99, "gauge", {}), (10, 11, "gauge", {})])).first()
    assert r["last"] == 99
    for order in ([5, 7], [7, 5]):
        assert rollup.scalars(points(spark, [(1, v, "gauge", {}) for v in order])).first()["last"] == 7


def test_arrival_order_and_batches_do_not_matter(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(400), rnd.choice([-3, 0, 0.0005, 0.002, 5, 77, 1e13, rnd.random() * 100]), "histogram", {"host": rnd.choice("ab")}) for _ in range(300)]
    key = lambda x: (x["label_hash"], x["window_start"])
    cols = ["count", "min", "max", "last", "last_event_at", "buckets"]
    want = {}
    for s, v, _, lab in rows:
        t = BASE + timedelta(seconds=s)
        want.setdefault((label_hash(lab), t.replace(second=0).replace(tzinfo=None)), Acc()).add(t.replace(tzinfo=None), float(v))
    whole = {key(x): x for x in rollup.build(points(spark, rows)).collect()}
    rnd.shuffle(rows)
    parts = rollup.merge(*[rollup.build(points(spark, rows[i::3])) for i in range(3)])
    parts = {key(x): x for x in parts.collect()}
    assert whole.keys() == parts.keys() == want.keys()
    for k, a in want.items():
        assert [whole[k][c] for c in cols] == [parts[k][c] for c in cols] == [a.count, a.min, a.max, a.latest[1], a.latest[0], a.slots]
        assert whole[k]["sum"] == pytest.approx(a.sum) and parts[k]["sum"] == pytest.approx(a.sum)


def test_label_hash(spark):
    cases = [{}, {"ab": "c"}, {"a": "bc"}, {"k\0v": ""}, {"k": "\0v"}, {"a=b": "c"}, {"a": "b=c"}, {"é": "ü", "b": "1"}]
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "m map<string,string>")
    got = [r[0] for r in df.select(L.label_hash(F.col("m"))).collect()]
    assert got == [label_hash(c) for c in cases] + [label_hash({})]
    assert len(set(got)) == len(cases)


def test_slots_and_quantiles(spark):
    values = [-5.0, -1.0, 0.0, 0.0, 1e-3, 1.15e-3, 1.0, 10.0, 1e12, 1e15, float("inf")] + [b * f for b in H.BOUNDS[::7] for f in (0.999, 1.001)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(H.slot(F.col("v"))).collect()]
    assert got == [slot(v) for v in values]
    rnd = random.Random(1)
    data = [rnd.uniform(1, 21) for _ in range(1800)] + [rnd.uniform(50, 250) for _ in range(190)] + [rnd.uniform(1000, 5000) for _ in range(10)]
    a = Acc()
    for v in data:
        a.add(0, v)
    df = spark.createDataFrame([(a.slots,)], "b array<bigint>")
    for q in (0.5, 0.9, 0.95, 0.99, 0.999, 1.0, 0.0, -1.0, 2.0):
        got, exact = df.select(H.quantile(F.col("b"), q)).first()[0], sorted(data)[max(0, min(len(data), int(-(-min(max(q, 0), 1) * len(data) // 1))) - 1)]
        assert got == H.quantile_of(a.slots, q) and exact <= got * (1 + 1e-9) and got <= exact * 1.16
    sparse = spark.createDataFrame([([(i, n) for i, n in enumerate(a.slots) if n],), ([],)], "e array<struct<slot: int, count: bigint>>")
    for q in (0.0, 0.5, 0.9, 0.99, 1.0):
        assert [r[0] for r in sparse.select(H.quantile_sparse(F.col("e"), q)).collect()] == [H.quantile_of(a.slots, q), None]
    bad = spark.createDataFrame([(None,), ([1, 2, 3],), ([0] * 150,), ([0] * 153,)], "b array<bigint>")
    assert [r[0] for r in bad.select(H.quantile(F.col("b"), 0.5)).collect()] == [None] * 4


def test_vector_add(spark):
    df = spark.createDataFrame([([1, 2], [3, 4]), (None, [1]), ([1], None), ([1, 2], [9])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(H.add(F.col("a"), F.col("b"))).collect()] == [[4, 6], [1], [1], [1, 2]]


@pytest.mark.parametrize("size", [1, 60, 86400, 604800])
def test_windows_partition_time(spark, size):
    micros = [0, -1, 1, -(10**15) - 7, 10**15 + 3, size * 10**6, size * 10**6 - 1, -size * 10**6]
    df = spark.createDataFrame([(m,) for m in micros], "m long").withColumn("t", F.timestamp_micros("m"))
    for r in df.select("m", F.unix_micros(start_of(F.col("t"), size)).alias("s"), F.unix_micros(end_of(start_of(F.col("t"), size), size)).alias("e")).collect():
        assert r.s <= r.m < r.e and r.s % (size * 10**6) == 0 and r.e - r.s == size * 10**6


def test_validation_boundaries(spark):
    now = BASE
    ok = ("m.a-b_1", "gauge", 1.0, now, {})
    cases = [
        (ok, []), (("a" * 200, *ok[1:]), []), (("a" * 201, *ok[1:]), ["metric:length"]), (("", *ok[1:]), ["metric:required"]), (("é" * 101, *ok[1:]), ["metric:length"]), (("a\n", *ok[1:]), ["metric:grammar"]),
        (("m", "Gauge", 1.0, now, {}), ["kind:unknown"]), (("m", "counter", 0.0, now, {}), []), (("m", "counter", -0.1, now, {}), ["value:negative"]), (("m", "gauge", 1e100, now, {}), []), (("m", "gauge", -1e100, now, {}), []),
        (("m", "gauge", 1e101, now, {}), ["value:finite"]), (("m", "gauge", float("nan"), now, {}), ["value:finite"]), (("m", "gauge", None, now, {}), ["value:required"]),
        (("m", "gauge", 1.0, now + timedelta(minutes=5), {}), []), (("m", "gauge", 1.0, now + timedelta(minutes=5, microseconds=1), {}), ["timestamp:future"]),
        (("m", "gauge", 1.0, now - timedelta(days=7), {}), []), (("m", "gauge", 1.0, now - timedelta(days=7, microseconds=1), {}), ["timestamp:old"]), (("m", "gauge", 1.0, None, {}), ["timestamp:required"]),
        (("m", "gauge", 1.0, now, {"a": ""}), []), (("m", "gauge", 1.0, now, {"": "x", "__a": "x", "a b": "x", "c": "\x7f"}), ["labels.:empty", "labels.__a:reserved", "labels.a b:key-grammar", "labels.c:value-control"]),
        (("m", "gauge", 1.0, now, {f"k{i}": "v" for i in range(20)}), []), (("m", "gauge", 1.0, now, {f"k{i}": "\x01" for i in range(21)}), ["labels:count"]), (("m", "gauge", 1.0, now, None), []),
        (("9", "x", -1.0, None, {}), ["metric:grammar", "kind:unknown", "timestamp:required"]),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, metric string, kind string, value double, timestamp timestamp, labels map<string,string>")
    got = {r.i: r.v for r in df.select("i", V.violations(now).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, v in cases]
    old = spark.createDataFrame([("m", "gauge", 1.0, now - timedelta(days=800), {})], "metric string, kind string, value double, timestamp timestamp, labels map<string,string>")
    assert old.select(V.violations()).first()[0] == []


def test_identity(spark):
    cases = {"a": True, "": False, " a": False, "a ": False, "a\tb": False, "é" * 127: True, "é" * 128: False}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(V.identity_ok(F.col("c"))).collect()] == list(cases.values())


def test_envelopes(spark):
    p = points(spark, [(0, 1, "gauge", {"a": 'q"x'}), (1, 2, "counter", {})], tenant='te"n')
    env = P.encode_envelopes(p)
    doc = json.loads(env.first()["envelope"])
    assert doc["schema_version"] == "1" and doc["tenant_id"] == 'te"n' and [x["value"] for x in doc["points"]] == [1.0, 2.0]
    back = P.envelope_points(P.decode_envelopes(env)).orderBy("idx").collect()
    assert [(x.metric, x.value, x.labels, x.timestamp) for x in back] == [(x.metric, x.value, x.labels, x.timestamp) for x in p.orderBy("idx").collect()]
    good = dict(metric="m", kind="gauge", value=1, timestamp="2020-01-01T00:00:00Z", labels={})
    def env_of(n=1, **kw):
        return json.dumps(dict(schema_version="1", batch_id="b", tenant_id="t", received_at="2020-01-01T00:00:00Z", points=[good] * n) | kw)
    cases = {
        env_of(): None, env_of(schema_version="2"): "version", env_of(tenant_id="a\x00"): "identity", env_of(batch_id="x" * 256): "identity", env_of(points=[]): "empty", env_of(1001): "points", env_of(1000): None, "{": "json",
        env_of(points=[good | {"kind": "z"}]): "point", env_of(points=[good | {"value": None}]): "point", env_of(points=[good | {"value": 1e101}]): "point", env_of(points=[good | {"kind": "counter", "value": -1}]): "point",
        env_of(points=[good | {"labels": {"__x": "1"}}]): "point", env_of(points=[good | {"timestamp": "9999-01-01T00:00:00Z"}]): "point", env_of(received_at="x"): "received_at",
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, envelope string")
    got = {r.i: r.fault for r in P.decode_envelopes(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_request_parsing():
    now = datetime(2024, 1, 2, tzinfo=UTC)
    r, bad = R.parse("t", {"metric": " m "}, now)
    assert not bad and (r.metric, r.aggregation, r.start, r.end) == ("m", "avg", now - timedelta(hours=1), now)
    r, bad = R.parse("t", {"metric": "a..b", "agg": " P95 ", "to": "-1h", "from": "-30m", "label.x": ["1", "2"]}, now)
    assert not bad and r.aggregation == "p95" and r.end == now - timedelta(hours=1) and r.start == now - timedelta(minutes=90) and r.labels == {"x": "1"}
    for params, name in (({}, "metric"), ({"metric": "m", "agg": "p42"}, "agg"), ({"metric": "m", "from": "-1d"}, "from"), ({"metric": "m", "from": "2024-01-02T00:00:00Z"}, "from"), ({"metric": "m", "to": "yesterday"}, "to"), ({"metric": "m", "label.9": "x"}, "label.9"), ({"metric": "m", "label.a": "é" * 129}, "label.a")):
        assert [n for n, _ in R.parse("t", params, now)[1]] == [name], params
    assert not R.parse("t", {"metric": "m", "from": "-744h"}, now)[1] and R.parse("t", {"metric": "m", "from": "-744h1us"}, now)[1]
    assert [R.limit_of(x) for x in (None, "", "x", "0", "-1", "7")] == [500] * 5 + [7]
    assert [R.capped(x, 500) for x in (0, 1, 500, 501)] == [500, 1, 500, 500]
    assert R.duration("-1h30m0.5s") == -timedelta(hours=1, minutes=30, seconds=0.5)


def test_caps_follow_the_model(spark):
    rnd = random.Random(7)
    rows = [(i * 60, rnd.random(), rnd.choice(["gauge", "histogram"]), {"h": str(rnd.randrange(8))}) for i in range(60) for _ in range(3)]
    r = rollup.build(points(spark, rows)).cache()
    scan = query.scan(r, "acme", "m", BASE, BASE + timedelta(hours=2))
    for agg in ("sum", "p90"):
        listed = [(x["kind"], x["label_hash"], x["window_start"], x["v"]) for x in scan.withColumn("v", rollup.statistic(agg)).orderBy(*query.scan_order()).collect()]
        for series, most in ((500, 50_000), (3, 50_000), (500, 20), (3, 20), (4, 0)):
            want, truncated, _ = build(listed, series, most)
            shaped = query.shaped(scan, agg, series, most)
            got = {}
            for x in query.ordered(shaped).collect():
                got.setdefault((x["kind"], x["label_hash"]), []).append((x["t"], x["v"]))
            assert got == want and list(got) == sorted(want, key=lambda g: ":".join(g))
            assert (not shaped.where("NOT keep").isEmpty()) == truncated
    req, _ = R.parse("acme", {"metric": "m", "agg": "p90"}, BASE + timedelta(hours=1, minutes=5), R.Limits(default_range=timedelta(hours=2)))
    a = query.answer(r, req)
    assert a["kind"] == "mixed" and a["warnings"] and not a["truncated"] and all(s["kind"] == "histogram" for s in a["series"])


def test_label_filter(spark):
    df = spark.createDataFrame([({"status": "200", "s": "checkout"},), ({"status": "500", "s": "checkout"},), ({"status": "200", "s": "search"},), (None,)], "labels map<string,string>")
    n = lambda w: df.where(L.contains(F.col("labels"), w)).count()
    assert [n({"status": "200"}), n({"status": "200", "s": "search"}), n({"status": "418"}), n({"x": "1"})] == [2, 1, 0, 0]


def test_display(spark):
    t = [0, 60, 120, 600, 660, 720]
    df = spark.createDataFrame([("gauge", "h", BASE + timedelta(seconds=s), float(i)) for i, s in enumerate(t)], "kind string, label_hash string, t timestamp, v double")
    assert [x.segment for x in display.segments(df).orderBy("t").collect()] == [0, 0, 0, 1, 1, 1]
    one = df.limit(1)
    assert [x.segment for x in display.segments(one).collect()] == [0] and display.median_delta(one).isEmpty()
    spike = spark.createDataFrame([("g", "h", i, 100.0 if i == 777 else float(i % 5)) for i in range(2000)], "kind string, label_hash string, t long, v double")
    kept = sorted((x.t, x.v) for x in display.decimate(spike, 100).collect())
    assert len(kept) <= 102 and (777, 100.0) in kept and kept[0][0] == 0 and kept[-1][0] == 1999
    cells = spark.createDataFrame([("=1",), ('a"b',), ("x=1",)], "c string").select(display.csv_cell(F.col("c"))).collect()
    assert [c[0] for c in cells] == ['"\'=1"', '"a""b"', '"x=1"']
    assert [x.t.second for x in display.nearest(df, F.lit(BASE + timedelta(seconds=30)).cast("timestamp")).collect()] == [0] and display.nearest(df, F.lit(BASE + timedelta(seconds=30)).cast("timestamp")).first().t.minute == 1
    a, b = display.fingerprint(df).first(), display.fingerprint(df.orderBy(F.desc("v"))).first()
    assert a == b != display.fingerprint(df.limit(5)).first()


def test_store_commits_merge_and_feed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    put = lambda rows, batch: store.commit("acme", rollup.build(points(spark, rows, batch=batch)), ledger.claims(points(spark, rows, batch=batch)), BASE)
    assert store.revision("acme") == 0 and store.rollups("acme").isEmpty()
    assert put([(0, 1, "histogram", {"i": "1"}), (1, 2, "histogram", {"i": "1"}), (2, 3, "histogram", {"i": "1"})], "b1") == 1
    assert put([(3, 10, "histogram", {"i": "1"}), (4, 20, "histogram", {"i": "1"}), (90, 5, "gauge", {"i": "2"})], "b2") == 2
    with pytest.raises(Conflict):
        put([(5, 8, "histogram", {"i": "1"})], "b1")
    assert store.revision("acme") == 2
    rows = sorted(store.rollups("acme").collect(), key=lambda r: r["window_start"])
    assert [(r["count"], r["sum"], r["min"], r["max"], r["revision"]) for r in rows] == [(5, 36, 1, 20, 2), (1, 5, 5, 5, 2)] and sum(rows[0]["buckets"]) == 5
    empty = points(spark, [(0, 1, "gauge", {})]).limit(0)
    assert store.commit("acme", rollup.build(empty), ledger.claims(points(spark, [(0, 1, "gauge", {})], batch="none")), BASE) == 2
    put([(300 + i, 1, "gauge", {"n": f"{i:02d}"}) for i in range(20)], "b3")
    cursor, seen = Cursor(2), []
    while page := store.changes("acme", cursor, 5).collect():
        seen += [r["label_hash"] for r in page]
        assert len(page) <= 5
        cursor = next_cursor(page)
    assert len(seen) == len(set(seen)) == 20
    tiny, n = Cursor(2), 0
    while page := store.changes("acme", tiny, 1000, budget=3000).collect():
        n, tiny = n + len(page), next_cursor(page)
    assert n == 20
    before = sorted(map(str, store.rollups("acme").collect()))
    assert store.compact("acme") and sorted(map(str, store.rollups("acme").collect())) == before and store.revision("acme") == 4
    assert store.compact("acme", BASE + timedelta(minutes=2)) and store.rollups("acme").count() == 21
    with pytest.raises(Conflict):
        put([(5, 8, "histogram", {"i": "1"})], "b1")
    store.expire_ledger("acme", BASE + timedelta(days=1))
    assert store.ledger("acme").isEmpty() and store.tenants() == ["acme"]


def test_ledger_and_reservations(spark):
    p = points(spark, [(0, 1, "gauge", {}), (70, 2, "gauge", {})])
    done = ledger.claims(p.where("idx = 0"))
    assert [r.idx for r in ledger.uncommitted(p, done).collect()] == [1]
    assert ledger.first_delivery(p.union(p)).count() == 2
    req = spark.createDataFrame([("t", "k1", "f", BASE), ("t", "k1", "g", BASE), ("t", "k2", "f", BASE), ("t", "k3", "f", BASE)], "tenant_id string, idempotency_key string, fingerprint string, at timestamp")
    held = spark.createDataFrame([("t", "k1", "f", "r1", BASE - timedelta(hours=1), BASE + timedelta(hours=1)), ("t", "k2", "f", "r2", BASE - timedelta(days=2), BASE)], "tenant_id string, idempotency_key string, fingerprint string, response string, created_at timestamp, expires_at timestamp")
    got = {(r.idempotency_key, r.fingerprint): (r.outcome, r.response) for r in ledger.reserve(req, held).collect()}
    assert got == {("k1", "f"): ("replay", "r1"), ("k1", "g"): ("conflict", None), ("k2", "f"): ("new", None), ("k3", "f"): ("new", None)}


def test_occurrences_are_ordered_by_time_and_value(spark):
    """As pairs of both are, for doubles of every size."""
    rnd = random.Random(3)
    values = [0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, 1.0, 2.0, 0.5, math.nextafter(1, 0), math.nextafter(1, 2), math.nextafter(8, 0), 1e100, 1e-100]
    values += [math.ldexp(rnd.random() + 0.5, rnd.randint(-1060, 1020)) for _ in range(200)] + [2.0**k for k in range(-1074, 1024, 7)]
    values = sorted({*values, *(-v for v in values)})
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate((t, v) for t in (-5, 0, 4_000_000_000_000_000) for v in values)], "i long, t long, v double")
    got = [r.occurrence for r in rollup.with_occurrence(df.withColumn("at", F.timestamp_micros("t")), "at", "v").orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


def test_rollups_are_hashed_not_sorted(spark):
    rows = points(spark, [(i, i, "histogram", {"a": "b"}) for i in range(5)])
    for df in (rollup.build(rows), rollup.scalars(rows), rollup.merge(rollup.build(rows), rollup.build(rows))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    odd = rollup.build(rows).withColumn("buckets", F.array(F.lit(1).cast("long")))
    assert rollup.merge(odd).first()["buckets"] is None and sum(rollup.merge(odd, rollup.build(rows)).first()["buckets"]) == 5


def test_store_bases_vacuum_and_races(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    from tidewell.plans import store as module

    monkeypatch.setattr(module, "BASE_EVERY", 3)
    store = Store(spark, f"file://{tmp_path}/store")
    put = lambda i: store.commit("acme", rollup.build(points(spark, [(60 * i, i, "gauge", {})], batch=f"b{i}")), ledger.claims(points(spark, [(60 * i, i, "gauge", {})], batch=f"b{i}")), BASE)
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(put, range(7))) == list(range(1, 8))
    assert store.rollups("acme").agg(F.sum("sum")).first()[0] == 21 and store.ledger("acme").count() == 7
    assert not store._create("commits/acme/000000000001.json", "{}") and store._manifest("acme", 1).get("data")
    opened = []
    monkeypatch.setattr(store, "_manifest", lambda t, n, f=store._manifest: opened.append(n) or f(t, n))
    assert len(store._live("acme", "data")) == 7 and opened == [6, 7]
    assert store.compact("acme") and len(store._live("acme", "data")) == 1
    folders = lambda: len(store._names("data"))
    assert folders() == 8 and store.vacuum("acme", datetime.now(UTC)) == 0
    assert store.vacuum("acme", datetime.now(UTC) + timedelta(days=2)) == 7 + 5 and folders() == 1
    assert store.rollups("acme").agg(F.sum("sum")).first()[0] == 21 and store.revision("acme") == 8
    with pytest.raises(Conflict):
        put(3)


def test_feed_by_metric_budget_and_tail(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")

    def put(batch, metric, rows):
        p = points(spark, rows, batch=batch).withColumn("metric", F.lit(metric))
        return store.commit("acme", rollup.build(p), ledger.claims(p), BASE)

    put("b1", "cpu", [(0, 1, "gauge", {"h": "1"}), (0, 1, "gauge", {"h": "2"})])
    put("b2", "disk", [(0, 5, "gauge", {"h": "1"})])
    assert [r["metric"] for r in store.changes("acme", Cursor(0), metric="disk").collect()] == ["disk"]
    assert store.changes("acme", Cursor(0)).count() == 3
    with pytest.raises(ValueError, match="budget"):
        store.changes("acme", Cursor(0), budget=100)
    news = iter([lambda: put("b3", "cpu", [(1, 2, "gauge", {"h": "1"}), (61, 4, "gauge", {"h": "2"})]), lambda: None, lambda: put("b4", "cpu", [(2, 3, "gauge", {"h": "1"})])])
    got = [[(r["labels"]["h"], r["sum"]) for r in rows] for rows in store.tail("acme", "cpu", polls=3, wait=lambda: next(news)())]
    assert [sorted(x) for x in got] == [[("1", 3.0), ("2", 4.0)], [], [("1", 6.0)]]
    req, bad = R.parse("acme", {"metric": "cpu", "from": "2024-03-01T12:00:00Z", "to": "2024-03-01T13:00:00Z"}, BASE)
    assert not bad
    small = query.MAX_READ_BYTES
    try:
        query.MAX_READ_BYTES = 1000
        assert query.over_budget(store.rollups("acme"), 1000) and not query.over_budget(store.rollups("acme"), small)
    finally:
        query.MAX_READ_BYTES = small

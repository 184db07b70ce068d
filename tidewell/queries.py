"""The engine's queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import histogram as H
from tidewell.functions import labels as L
from tidewell.functions import validate as V
from tidewell.operators import discover, display, ledger, query, rollup
from tidewell.plans.request import AGGREGATIONS
from tidewell.plans.store import Cursor, change_page, expired
from tidewell.sources import points as P

HOUR = 3600
TENANT, METRIC = "tenant-1", "events.view"
START, END = datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC)
NOW = datetime(2024, 1, 25, tzinfo=UTC)
_SERIES = ["tenant_id", "metric", "kind", "label_hash", "window_start"]


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return P.events_as_points(spark, sf)


def _round(c: str) -> Column:
    return F.round(c, 6).alias(c)


# Rollups and statistics ------------------------------------------------------------------------------------------------
def rollup_hourly(spark, sf):
    r = rollup.scalars(_points(spark, sf), HOUR)
    return r.select(*_SERIES, "window_end", "count", _round("sum"), "min", "max", "last", "last_event_at")


def _agg(name: str):
    def run(spark, sf):
        if name in H.QUANTILES:
            r = rollup.percentile(_points(spark, sf), 24 * HOUR, H.QUANTILES[name])
            return r.select(*_SERIES, F.round("v", 6).alias("v"))
        return rollup.scalars(_points(spark, sf), 24 * HOUR).select(*_SERIES, F.round(rollup.statistic(name), 6).alias("v"))

    return run


def p95_by_metric(spark, sf):
    """Flagship: p95 per tenant, metric and day, over all label sets, from merged histograms."""
    rows = _points(spark, sf).where("kind = 'histogram'").withColumn("labels", F.create_map().cast("map<string,string>"))
    r = rollup.percentile(rows, 24 * HOUR, 0.95)
    return r.select("tenant_id", "metric", "window_start", "count", F.round("v", 6).alias("p95")).orderBy("tenant_id", "metric", "window_start")


def histogram_vector(spark, sf):
    return rollup.sparse_slots(_points(spark, sf), 24 * HOUR)


def label_hash(spark, sf):
    p = _points(spark, sf)
    return p.select("event_id", L.label_hash(F.col("labels")).alias("label_hash"), L.display(F.col("labels")).alias("shown"))


def merge_partials(spark, sf):
    """Two halves rolled up apart and merged: equal to rolling up everything."""
    p = _points(spark, sf)
    half = F.col("event_id") % 2 == 0
    r = rollup.merge(rollup.build(p.where(half), 24 * HOUR), rollup.build(p.where(~half), 24 * HOUR))
    return r.select(*_SERIES, "count", _round("sum"), "min", "max", "last", "last_event_at", F.round(rollup.statistic("p90"), 6).alias("p90"))


def vector_add(spark, sf):
    """Totals of pairwise added vectors, with the length rule: a short vector is ignored on the right."""
    r = rollup.build(_points(spark, sf).where("kind = 'histogram'"), 24 * HOUR)
    both = H.add(F.col("buckets"), F.col("buckets"))
    short = H.add(F.col("buckets"), F.array(F.lit(1).cast("long")))
    return r.select(*_SERIES, H.total(both).alias("doubled"), H.total(short).alias("kept"), H.total(H.add(F.lit(None).cast("array<bigint>"), F.col("buckets"))).alias("right_only"))


def nearest_rank(spark, sf):
    return rollup.nearest_rank(_points(spark, sf), ["metric"], "value", 0.95).select("metric", F.col("value").alias("p95"))


def status_counts(spark, sf):
    return _points(spark, sf).groupBy("kind", "metric").agg(F.count(F.lit(1)).alias("n"))


def default_agg(spark, sf):
    return _points(spark, sf).select("kind").distinct().select("kind", rollup.default_aggregation(F.col("kind")).alias("agg"))


def window_assign(spark, sf):
    from tidewell.functions.windows import end_of, start_of

    out = _points(spark, sf)
    shifted = F.timestamp_micros(F.unix_micros("timestamp") - F.lit(60 * 365 * 86400 * 1_000_000))
    s, e = start_of(F.col("timestamp"), 7 * 86400), start_of(shifted, 900)
    return out.select("event_id", s.alias("week"), end_of(s, 7 * 86400).alias("week_end"), e.alias("early"))


# Filters, discovery ----------------------------------------------------------------------------------------------------
def filter_labels(spark, sf):
    r = rollup.scalars(_points(spark, sf), HOUR)
    rows = query.in_range(r, TENANT, METRIC, START, END, {"k": "2"})
    return rows.select(*_SERIES, "count", _round("sum"))


def scan_newest(spark, sf):
    r = rollup.scalars(_points(spark, sf), HOUR)
    return query.scan(r, TENANT, METRIC, START, END, limit=100).select(*_SERIES, "count", _round("sum"))


def scan_plain(spark, sf):
    r = rollup.scalars(_points(spark, sf), HOUR)
    return query.scan_plain(r, TENANT, METRIC, START, END, 50).select(*_SERIES, "count", _round("sum"))


def metrics_summary(spark, sf):
    return discover.metrics(rollup.scalars(_points(spark, sf), HOUR), TENANT)


def label_keys(spark, sf):
    return discover.label_keys(rollup.scalars(_points(spark, sf), HOUR), TENANT, METRIC)


def label_values(spark, sf):
    return discover.label_values(rollup.scalars(_points(spark, sf), HOUR), TENANT, METRIC, "shard")


def metric_names(spark, sf):
    return discover.metric_names(rollup.scalars(_points(spark, sf), HOUR), TENANT)


def series_search(spark, sf):
    r = rollup.scalars(_points(spark, sf), 24 * HOUR).groupBy("kind", "label_hash").agg(F.first("labels").alias("labels"))
    return query.search(r, 'SHARD":"3').select("kind", "label_hash", L.canonical_json(F.col("labels")).alias("labels"))


# Range query with caps -------------------------------------------------------------------------------------------------
def _capped(agg: str, series: int, points: int, rows: int):
    def run(spark, sf):
        r = rollup.build(_points(spark, sf), 24 * HOUR)
        cut = query.scan(r, TENANT, METRIC, START, END, limit=rows)
        out = query.ordered(query.shaped(cut, agg, series, points))
        return out.select("kind", "label_hash", L.canonical_json(F.col("labels")).alias("labels"), "t", F.round("v", 6).alias("v"))

    return run


def kind_roll_up(spark, sf):
    r = rollup.scalars(_points(spark, sf), 24 * HOUR)
    return r.groupBy("tenant_id").agg(F.when(F.count_distinct("kind") > 1, "mixed").otherwise(F.min("kind")).alias("kind"))


def read_budget(spark, sf):
    r = rollup.build(_points(spark, sf), 24 * HOUR)
    return r.select(*_SERIES, query.cost(r).alias("cost"), L.state_cost(F.col("tenant_id"), F.col("metric"), F.col("label_hash"), F.col("kind"), F.col("labels")).alias("state"))


def stream_event(spark, sf):
    r = rollup.scalars(_points(spark, sf), HOUR).withColumn("buckets", F.lit(None).cast("array<bigint>"))
    e = query.stream_events(r)
    return e.select("metric", "kind", L.canonical_json(F.col("labels")).alias("labels"), "window_start", "window_end", "count", _round("sum"), _round("avg"), "min", "max", "last")


# Validation and envelopes ----------------------------------------------------------------------------------------------
def corrupted(spark, sf) -> DataFrame:
    """Events broken in a different way by event_id, one rule each."""
    p = _points(spark, sf)
    n = F.col("event_id") % 26
    pick = lambda cases, other: reduce(lambda a, kv: a.when(n == kv[0], kv[1]), cases.items(), F.when(F.lit(False), other)).otherwise(other)
    metric = pick({1: F.lit(""), 2: F.lit("x" * 201), 3: F.lit("9bad"), 4: F.lit("a..b"), 5: F.lit("a."), 6: F.lit("né")}, F.col("metric"))
    kind = pick({7: F.lit(""), 8: F.lit("Gauge"), 9: F.lit("counter")}, F.col("kind"))
    value = pick({9: F.lit(-1.0), 10: F.lit(None).cast("double"), 11: F.lit(float("nan")), 12: F.lit(1.1e100), 13: F.lit(-1e100)}, F.col("value"))
    ts = pick({14: F.lit(None).cast("timestamp"), 15: F.lit(datetime(1600, 1, 1, tzinfo=UTC)).cast("timestamp"), 16: F.lit(NOW + timedelta(minutes=5)).cast("timestamp")}, F.col("timestamp"))
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    many = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: F.concat(F.lit("l"), i.cast("string"))), F.array_repeat(F.lit("v"), 21))
    labels = pick({17: one("", "v"), 18: one("__own", "v"), 19: one("k" * 65, "v"), 20: one("a-b", "v"), 21: one("a", "é" * 129), 22: many, 23: one("a", "x\ty"), 24: F.create_map(F.lit("a"), F.unhex(F.lit("61FF")).cast("string"))}, F.col("labels"))
    return p.withColumns({"metric": metric, "kind": kind, "value": value, "timestamp": ts, "labels": labels})


def validate_points(spark, sf):
    return V.check(corrupted(spark, sf), NOW).select("event_id", F.array_join("violations", ";").alias("violations"))


def partial_success(spark, sf):
    s = V.summary(corrupted(spark, sf).withColumn("batch_id", F.concat(F.lit("b-"), F.floor(F.col("event_id") / 100).cast("string"))), None)
    return s.select("tenant_id", "batch_id", "accepted", "rejected", F.size("errors").cast("long").alias("shown"), "errors_truncated")


def envelope_round_trip(spark, sf):
    """Points packed into one envelope per batch, decoded, checked, and rolled up."""
    env = P.encode_envelopes(_points(spark, sf))
    decoded = P.decode_envelopes(env.select("envelope"))
    r = rollup.scalars(P.envelope_points(decoded), 24 * HOUR)
    return r.select(*_SERIES, "count", _round("sum"), "min", "max", "last")


def envelope_faults(spark, sf):
    """Envelopes damaged in turn: version, identity, emptiness, json; the rest pass."""
    env = P.encode_envelopes(_points(spark, sf)).withColumn("n", F.substring_index("batch_id", "-", -1).cast("int") % 5)
    e = F.col("envelope")
    bad = F.when(F.col("n") == 1, F.regexp_replace(e, '"schema_version":"1"', '"schema_version":"2"')).when(F.col("n") == 2, F.regexp_replace(e, '"tenant_id":"', '"tenant_id":" ')).when(F.col("n") == 3, F.regexp_replace(e, r'"points":\[.*\]\}$', '"points":[]}')).when(F.col("n") == 4, F.lit("{")).otherwise(e)
    return P.decode_envelopes(env.withColumn("envelope", bad)).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


# Ledger, store algebra -------------------------------------------------------------------------------------------------
def _twice(p: DataFrame) -> DataFrame:
    return p.union(p.where(F.col("event_id") % 3 == 0))


def dedup_ledger(spark, sf):
    """Deliveries repeated; windows that the ledger has are skipped; the rest rolled up."""
    p = _points(spark, sf)
    committed = ledger.claims(p.where(F.substring_index("batch_id", "-", -1).cast("int") % 4 == 0), 24 * HOUR)
    fresh = ledger.uncommitted(ledger.first_delivery(_twice(p)), committed, 24 * HOUR)
    return rollup.scalars(fresh, 24 * HOUR).select(*_SERIES, "count", _round("sum"))


def claims_committed(spark, sf):
    p = _points(spark, sf)
    done = ledger.claims(p.where("kind = 'counter'"), 24 * HOUR)
    return ledger.claims(p, 24 * HOUR).join(done, ledger.PAIR, "left_semi")


def batch_windows(spark, sf):
    return ledger.claims(_points(spark, sf), 6 * HOUR)


def _deltas(spark, sf) -> DataFrame:
    """Ten deltas of every tenant: batches by number, revision by delta."""
    p = _points(spark, sf).withColumn("delta", (F.substring_index("batch_id", "-", -1).cast("long") % 10 + 1))
    w = rollup.windowed(p, 24 * HOUR)
    r = w.groupBy("delta", *_SERIES).agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.max(F.struct("timestamp", "value")).alias("l"), F.first("labels").alias("labels"))
    return r.select(
        *_SERIES, "labels", F.timestamp_micros(F.unix_micros("window_start") + 86_400_000_000).alias("window_end"), "count", "sum", "min", "max", F.col("l.value").alias("last"), F.col("l.timestamp").alias("last_event_at"),
        F.lit(None).cast("array<bigint>").alias("buckets"), F.col("delta").alias("revision"),
    )


def change_feed_page(spark, sf):
    """A page of a tenant's feed, which the byte budget cuts."""
    own = _deltas(spark, sf).where(F.col("tenant_id") == TENANT)
    page = change_page(own, Cursor(8, METRIC, "histogram", "8", datetime(2024, 1, 10, tzinfo=UTC)))
    return page.select("revision", "metric", "kind", "label_hash", "window_start", "count", _round("sum"), "last")


def change_feed_metric(spark, sf):
    """The same of one metric, cut by rows."""
    own = _deltas(spark, sf).where(F.col("tenant_id") == TENANT)
    page = change_page(own, Cursor(3, METRIC, "histogram", "8", datetime(2024, 1, 10, tzinfo=UTC)), 60, metric=METRIC)
    return page.select("revision", "metric", "kind", "label_hash", "window_start", "count", _round("sum"), "last")


def sse_frames(spark, sf):
    return query.sse_frames(rollup.merge(_deltas(spark, sf)).withColumns({c: F.round(c, 6) for c in ("sum", "min", "max", "last")}))


def newest_revision(spark, sf):
    """Per tenant, of all metrics and of one that not every delta has; 0 for a metric without rows."""
    newest = lambda metric: F.coalesce(F.max(F.when(metric, F.col("revision"))), F.lit(0).cast("long"))
    d = _deltas(spark, sf).groupBy("tenant_id")
    return d.agg(newest(F.lit(True)).alias("newest"), newest((F.col("metric") == "events.error") & (F.col("revision") < 8)).alias("older_error"), newest(F.col("metric") == "none").alias("none"))


def store_merge(spark, sf):
    r = rollup.merge(_deltas(spark, sf))
    return r.select(*_SERIES, "count", _round("sum"), "min", "max", "last", "last_event_at", "revision")


def retention(spark, sf):
    r = rollup.scalars(_points(spark, sf), HOUR)
    gone = expired(r, datetime(2024, 2, 10, tzinfo=UTC), 30)
    return gone.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("expired"), F.max("window_end").alias("newest"))


def idempotent_requests(spark, sf):
    """Requests by user: the key repeats every 50 users, the body every 10; an earlier request holds the key for two days."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'")
    body = F.sha2((F.col("user_id") % 10).cast("string"), 256)
    key = F.concat(F.lit("key-"), (F.col("user_id") % 50).cast("string"))
    ts = F.col("ts").cast("timestamp")
    base = e.select(F.lit("t").alias("tenant_id"), key.alias("idempotency_key"), body.alias("fingerprint"), ts.alias("at"), "event_id")
    held = base.where(F.col("event_id") % 2 == 0).select("tenant_id", "idempotency_key", "fingerprint", F.concat(F.lit("answer-"), F.col("event_id").cast("string")).alias("response"), F.col("at").alias("created_at"), (F.col("at") + F.expr("INTERVAL 2 DAYS")).alias("expires_at"), "event_id")
    held = held.withColumn("created_at", F.struct("created_at", "event_id"))
    out = ledger.reserve(base.where(F.col("event_id") % 2 == 1), held)
    return out.select("event_id", "idempotency_key", "outcome", "response")


# Display ---------------------------------------------------------------------------------------------------------------
_OWN = ["tenant_id", "metric", "kind", "label_hash"]


def _answer(spark, sf) -> DataFrame:
    """Averages by hour of all series."""
    r = rollup.scalars(_points(spark, sf), HOUR)
    return r.select(*_OWN, "labels", F.col("window_start").alias("t"), (F.col("sum") / F.col("count")).alias("v"))


def gap_segments(spark, sf):
    return display.segments(_answer(spark, sf), _OWN).select(*_OWN, "t", "segment")


def median_interval(spark, sf):
    return display.median_delta(_answer(spark, sf), _OWN)


def _dense(spark, sf) -> DataFrame:
    """One long series per event type: every event as a point, value in whole units so that ties occur."""
    p = _points(spark, sf)
    return p.select("kind", F.col("metric").alias("label_hash"), F.col("event_id").alias("t"), F.floor("value").cast("double").alias("v"))


def decimate(spark, sf):
    return display.decimate(_dense(spark, sf), 100)


def csv_export(spark, sf):
    """Averages by hour as lines; sums run in the order of the table, so that averages at a rounding tie go one way."""
    a = rollup.averages_in_order(P.events_as_points(spark, sf, placed=True), HOUR, ["file", "row"]).withColumnRenamed("window_start", "t")
    return display.csv_lines(a.withColumn("v", display.rounded(F.col("v"), 3)), F.col("metric"), L.canonical_json(F.col("labels"))).select("line")


def csv_guard(spark, sf):
    p = _points(spark, sf)
    lead = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "\t", "\r", "", 'q"')]), (F.col("event_id") % 8 + 1).cast("int"))
    return p.select("event_id", display.csv_cell(F.concat(lead, F.col("metric"))).alias("cell"))


def series_stats(spark, sf):
    return discover.series_stats(_answer(spark, sf), tuple(_OWN)).select(*_OWN, _round("latest"), _round("min"), _round("max"), "n")


def nearest_point(spark, sf):
    out = display.nearest(_answer(spark, sf), F.lit(datetime(2024, 1, 12, 12, 0, tzinfo=UTC)).cast("timestamp"), _OWN)
    return out.select(*_OWN, "t", _round("v"))


def reconcile(spark, sf):
    """Rollups against a direct count: rows that differ, by a full outer join; none are expected."""
    p = _points(spark, sf)
    a = rollup.scalars(p, 24 * HOUR).groupBy("tenant_id", "window_start").agg(F.sum("count").alias("rolled"))
    b = p.groupBy("tenant_id", F.date_trunc("day", "timestamp").alias("window_start")).agg(F.count(F.lit(1)).alias("direct"))
    both = a.join(b, ["tenant_id", "window_start"], "full_outer")
    return both.agg(F.count(F.lit(1)).alias("windows"), F.sum(F.when(F.col("rolled").eqNullSafe(F.col("direct")), 0).otherwise(1)).cast("long").alias("mismatches"))


def pressure_rollup(spark, sf):
    """The deterministic load, as many points as there are events."""
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    r = rollup.scalars(P.pressure(spark, n, NOW), 60)
    return r.select("kind", F.element_at("labels", F.lit("host")).alias("host"), "window_start", "count", "sum", "min", "max", "last")


def table_fingerprint(spark, sf):
    return display.fingerprint(rollup.scalars(_points(spark, sf), 24 * HOUR).select("tenant_id", "metric", "window_start", "count"))


QUERIES = {
    "p95_by_metric": p95_by_metric, "rollup_hourly": rollup_hourly, **{f"agg_{a}": _agg(a) for a in AGGREGATIONS}, "histogram_vector": histogram_vector, "label_hash": label_hash,
    "merge_partials": merge_partials, "vector_add": vector_add, "nearest_rank": nearest_rank, "status_counts": status_counts, "default_agg": default_agg, "window_assign": window_assign,
    "filter_labels": filter_labels, "scan_newest": scan_newest, "scan_plain": scan_plain, "metrics_summary": metrics_summary, "label_keys": label_keys, "label_values": label_values, "metric_names": metric_names,
    "series_search": series_search, "query_capped": _capped("sum", 7, 40, 400), "query_quantile": _capped("p95", 500, 50_000, 50_001), "kind_roll_up": kind_roll_up, "read_budget": read_budget, "stream_event": stream_event,
    "validate_points": validate_points, "partial_success": partial_success, "envelope_round_trip": envelope_round_trip, "envelope_faults": envelope_faults, "dedup_ledger": dedup_ledger,
    "claims_committed": claims_committed, "batch_windows": batch_windows, "change_feed_page": change_feed_page, "change_feed_metric": change_feed_metric, "sse_frames": sse_frames, "newest_revision": newest_revision, "store_merge": store_merge, "retention": retention,
    "idempotent_requests": idempotent_requests, "gap_segments": gap_segments, "median_interval": median_interval, "decimate": decimate, "csv_export": csv_export, "csv_guard": csv_guard, "series_stats": series_stats,
    "nearest_point": nearest_point, "reconcile": reconcile, "pressure_rollup": pressure_rollup, "table_fingerprint": table_fingerprint,
}

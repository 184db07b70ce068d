"""Sources of points: the events table, JSON batches, envelopes, and generated loads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import validate as V
from tidewell.schema import ENVELOPE, POINT_JSON

# Fixed values.
VERSION = "1"
MAX_ENVELOPE_BYTES = 10_000_000


def events_as_points(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """The ``events`` table as points: four tenants, a batch per hundred events, kinds by event type.

    ``placed`` adds (file, row), the place of the event in the table.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "counter").when(F.col("event_type").isin("purchase", "view"), "histogram").otherwise("gauge")
    labels = F.create_map(
        F.lit("shard"), (F.col("user_id") % 10).cast("string"), F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string")
    )
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("b-"), F.floor(F.col("event_id") / 100).cast("string")).alias("batch_id"),
        ts.alias("received_at"), (F.col("event_id") % 100).cast("int").alias("idx"), F.concat(F.lit("events."), F.col("event_type")).alias("metric"),
        kind.alias("kind"), F.col("value"), ts.alias("timestamp"), labels.alias("labels"), F.col("event_id"),
        *([F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if placed else []),
    )


def lineitem_as_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as histogram points: the extended price at the ship date; a larger load for benchmarks."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ts = F.col("l_shipdate").cast("timestamp")
    labels = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    return t.select(
        F.concat(F.lit("tenant-"), (F.col("l_suppkey") % 4).cast("string")).alias("tenant_id"), F.concat(F.lit("o-"), F.col("l_orderkey").cast("string")).alias("batch_id"),
        ts.alias("received_at"), F.col("l_linenumber").alias("idx"), F.lit("line.price").alias("metric"), F.lit("histogram").alias("kind"), F.col("l_extendedprice").alias("value"),
        ts.alias("timestamp"), labels.alias("labels"),
    )


def read_batches(spark: SparkSession, path: str, tenant: str, received_at: datetime) -> DataFrame:
    """JSON batch documents ``{"batch_id": ..., "points": [...]}`` with a fixed schema; one row per point."""
    rows = spark.read.schema(f"batch_id string, points array<struct<{POINT_JSON}>>").json(path, multiLine=True)
    return _points(rows.withColumns({"tenant_id": F.lit(tenant), "received_at": F.lit(received_at).cast("timestamp")}))


def _points(rows: DataFrame) -> DataFrame:
    flat = rows.select("tenant_id", "batch_id", "received_at", F.posexplode("points").alias("idx", "p")).select("tenant_id", "batch_id", "received_at", "idx", "p.*")
    return flat.withColumn("timestamp", F.try_to_timestamp("timestamp"))


def encode_envelopes(points: DataFrame) -> DataFrame:
    """(tenant_id, batch_id, envelope): one JSON document per batch, points in order."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    point = F.to_json(F.struct("metric", "kind", "value", stamp(F.col("timestamp")).alias("timestamp"), "labels"))
    rows = points.groupBy("tenant_id", "batch_id").agg(F.max("received_at").alias("received_at"), F.sort_array(F.collect_list(F.struct(F.col("idx"), point.alias("p")))).alias("v"))
    body = F.array_join(F.transform("v", lambda x: x["p"]), ",")
    head = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "batch_id", "tenant_id", stamp(F.col("received_at")).alias("received_at")))
    text = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"points":['), body, F.lit("]}"))
    # An envelope that no reader would take is an error of the writer.
    bounded = F.when(F.octet_length(text) <= MAX_ENVELOPE_BYTES, text).otherwise(F.raise_error(F.concat(F.lit("envelope too large: "), F.col("batch_id"))))
    return rows.withColumn("head", head).select("tenant_id", "batch_id", bounded.alias("envelope"))


def decode_envelopes(df: DataFrame, column: str = "envelope") -> DataFrame:
    """``df`` with ``doc`` (the parsed envelope) and ``fault``: null, or why the envelope can never be accepted."""
    doc = F.from_json(F.col(column), ENVELOPE, {"mode": "PERMISSIVE"})
    out = df.withColumn("doc", doc)
    ts = F.try_to_timestamp(F.col("doc.received_at"))
    n = F.size("doc.points")
    stored = F.transform("doc.points", _point_ok)
    fault = (
        F.when(F.octet_length(column) > MAX_ENVELOPE_BYTES, "size")
        .when(F.col("doc").isNull() | F.col("doc.schema_version").isNull(), "json")
        .when(F.col("doc.schema_version") != VERSION, "version")
        .when(~V.identity_ok(F.col("doc.batch_id")) | ~V.identity_ok(F.col("doc.tenant_id")), "identity")
        .when(ts.isNull() | ~F.year(ts).between(1678, 2261), "received_at")
        .when(F.coalesce(n, F.lit(0)) < 1, "empty")
        .when(n > V.MAX_BATCH_POINTS, "points")
        .when(~F.forall(stored, lambda x: x), "point")
    )
    return out.withColumn("fault", fault)


def _point_ok(p: Column) -> Column:
    value, kind, ts = p["value"], p["kind"], F.try_to_timestamp(p["timestamp"])
    rules = [V.metric_rule(p["metric"]), V.kind_rule(kind), V.value_rule(value), V.counter_rule(kind, value), V.timestamp_rule(ts, None)]
    ok = F.size(V.label_rules(p["labels"])) == 0
    for r in rules:
        ok = ok & r.isNull()
    return ok


def envelope_points(decoded: DataFrame) -> DataFrame:
    """Points of the envelopes without a fault."""
    good = decoded.where("fault IS NULL").select(F.col("doc.tenant_id").alias("tenant_id"), F.col("doc.batch_id").alias("batch_id"), F.try_to_timestamp(F.col("doc.received_at")).alias("received_at"), F.col("doc.points").alias("points"))
    return _points(good)


def quarantine(decoded: DataFrame) -> DataFrame:
    """Envelopes that would fail again, with the reason: what a dead-letter queue gets."""
    return decoded.where("fault IS NOT NULL").drop("doc")


def pressure(spark: SparkSession, n: int, at: datetime) -> DataFrame:
    """A deterministic load: kind by n % 3, host by n % 200, value n % 17 + 1, one timestamp."""
    host = (F.col("id") % 200).cast("string")
    kind = F.element_at(F.array(F.lit("counter"), F.lit("gauge"), F.lit("histogram")), (F.col("id") % 3 + 1).cast("int"))
    labels = F.create_map(F.lit("host"), F.concat(F.lit("host-"), host), F.lit("region"), F.lit("local"), F.lit("detail"), F.lit("x" * 128))
    return spark.range(n).select(
        F.lit("pressure").alias("tenant_id"), F.concat(F.lit("b-"), F.floor(F.col("id") / 500).cast("string")).alias("batch_id"), F.lit(at).cast("timestamp").alias("received_at"),
        (F.col("id") % 500).cast("int").alias("idx"), F.lit("load.value").alias("metric"), kind.alias("kind"), (F.col("id") % 17 + 1).cast("double").alias("value"),
        F.lit(at).cast("timestamp").alias("timestamp"), labels.alias("labels"),
    )


def random_load(spark: SparkSession, n: int, at: datetime, seed: int = 0, hosts: int = 10) -> DataFrame:
    """Histogram points of 5 + Exp(20), one in a hundred raised by 500, rounded to cents."""
    value = 5 - 20 * F.log(1 - F.rand(seed)) + F.when(F.rand(seed + 1) < 0.01, 500).otherwise(0)
    labels = F.create_map(F.lit("host"), F.format_string("host-%02d", F.col("id") % hosts), F.lit("source"), F.lit("load"))
    return spark.range(n).select(
        F.lit("load").alias("tenant_id"), F.concat(F.lit("b-"), F.floor(F.col("id") / 500).cast("string")).alias("batch_id"), F.lit(at).cast("timestamp").alias("received_at"),
        (F.col("id") % 500).cast("int").alias("idx"), F.lit("load.latency").alias("metric"), F.lit("histogram").alias("kind"), F.round(value, 2).alias("value"),
        F.timestamp_micros(F.lit(int(at.timestamp() * 1e6)) + F.col("id") * 1000).alias("timestamp"), labels.alias("labels"),
    )


def stream_batches(spark: SparkSession, folder: str, tenant: str) -> DataFrame:
    """A stream of points from JSON batch documents that arrive in a folder, one file each; they count as received when read."""
    rows = spark.readStream.schema(f"batch_id string, points array<struct<{POINT_JSON}>>").option("multiLine", "true").json(folder)
    return _points(rows.withColumns({"tenant_id": F.lit(tenant), "received_at": F.current_timestamp()}))


def publish(points: DataFrame, folder: str) -> None:
    """Append the envelopes of ``points`` to a landing folder, a line each; ``subscribe`` reads it as a stream.

    Files appear whole, as Spark commits them; the same batch published again is one more delivery, which the ledger drops.
    """
    encode_envelopes(points).select("envelope").write.mode("append").text(folder)


def subscribe(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """The envelopes of a landing folder as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder).withColumnRenamed("value", "envelope")

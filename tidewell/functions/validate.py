"""Admission rules for points, as columns: every broken rule is reported, in a fixed order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MAX_METRIC_BYTES = 200
MAX_LABELS = 20
MAX_KEY_BYTES = 64
MAX_VALUE_BYTES = 256
MAX_IDENTITY_BYTES = 255
MAX_MAGNITUDE = 1e100
MAX_BATCH_POINTS = 1000
FUTURE = "INTERVAL 5 MINUTES"
PAST = "INTERVAL 7 DAYS"
KINDS = ("gauge", "counter", "histogram")
ERRORS_SHOWN = 100

_METRIC = r"^[A-Za-z_][A-Za-z0-9_.\-]*\z"
_KEY = r"^[A-Za-z_][A-Za-z0-9_]*\z"
_CONTROL = r"[\x00-\x1f\x7f]"


def identity_ok(c: Column) -> Column:
    """Non-empty, at most 255 bytes of UTF-8, no outer white space, no control characters."""
    edge = r"(?U)^\s|\s\z"
    return F.coalesce((c != "") & (F.octet_length(c) <= MAX_IDENTITY_BYTES) & F.is_valid_utf8(c) & ~c.rlike(edge) & ~c.rlike(_CONTROL), F.lit(False))


def metric_rule(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == ""), "metric:required")
        .when(F.octet_length(c) > MAX_METRIC_BYTES, "metric:length")
        .when(~c.rlike(_METRIC), "metric:grammar")
        .when(c.endswith(".") | c.contains(".."), "metric:segment")
    )


def kind_rule(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "kind:required").when(~c.isin(*KINDS), "kind:unknown")


def value_rule(c: Column) -> Column:
    """Zero is a value; null, NaN, infinities and magnitudes over 1e100 are not."""
    return F.when(c.isNull(), "value:required").when(F.isnan(c) | (F.abs(c) > MAX_MAGNITUDE), "value:finite")


def counter_rule(kind: Column, value: Column) -> Column:
    return F.when((kind == "counter") & (value < 0) & ~F.isnan(value), "value:negative")


def timestamp_rule(ts: Column, now: datetime | None) -> Column:
    """Years 1678 to 2261; with ``now``, no more than 5 minutes ahead and 7 days back, bounds included."""
    ts = ts.cast("timestamp")
    rule = F.when(ts.isNull() | (ts == F.to_timestamp(F.lit("0001-01-01 00:00:00"))), "timestamp:required").when(~F.year(ts).between(1678, 2261), "timestamp:year")
    if now is not None:
        at = F.lit(now).cast("timestamp")
        rule = rule.when(ts > at + F.expr(FUTURE), "timestamp:future").when(ts < at - F.expr(PAST), "timestamp:old")
    return rule


def label_rules(labels: Column) -> Column:
    """More than 20 labels is one violation; else the first broken rule of each label, by key."""

    def rule(k: Column, v: Column) -> Column:
        found = (
            F.when(k == "", "empty")
            .when(k.startswith("__"), "reserved")
            .when(F.octet_length(k) > MAX_KEY_BYTES, "key-length")
            .when(~k.rlike(_KEY), "key-grammar")
            .when(F.octet_length(v) > MAX_VALUE_BYTES, "value-length")
            .when(~F.is_valid_utf8(v), "value-utf8")
            .when(v.rlike(_CONTROL), "value-control")
        )
        return F.concat(F.lit("labels."), k, F.lit(":"), found)

    each = F.transform(F.sort_array(F.map_keys(labels)), lambda k: rule(k, F.element_at(labels, k)))
    each = F.coalesce(F.filter(each, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size(F.map_keys(labels)), F.lit(0)) > MAX_LABELS, F.array(F.lit("labels:count"))).otherwise(each)


def violations(now: datetime | None = None, prefix: Column | None = None) -> Column:
    """Array of broken rules of a point; empty when it is valid. ``prefix`` goes before each, such as ``points.3.``."""
    single = F.array(metric_rule(F.col("metric")), kind_rule(F.col("kind")), value_rule(F.col("value")), counter_rule(F.col("kind"), F.col("value")), timestamp_rule(F.col("timestamp"), now))
    found = F.concat(F.filter(single, lambda x: x.isNotNull()), label_rules(F.col("labels")))
    return found if prefix is None else F.transform(found, lambda x: F.concat(prefix, x))


def normalise(points: DataFrame) -> DataFrame:
    """A missing timestamp becomes the time of arrival."""
    return points.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.col("received_at")))


def check(points: DataFrame, now: datetime | None = None) -> DataFrame:
    return points.withColumn("violations", violations(now))


def split(points: DataFrame, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): partial success keeps the valid points of a batch."""
    checked = check(points, now)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def summary(points: DataFrame, now: datetime | None = None) -> DataFrame:
    """Per batch: accepted, rejected, the first 100 errors by position, and whether more were left out."""
    checked = check(points, now)
    good = (F.size("violations") == 0).cast("long")
    path = F.transform("violations", lambda x: F.struct(F.col("idx"), F.concat(F.lit("points."), F.col("idx").cast("string"), F.lit("."), x).alias("error")))
    out = checked.groupBy("tenant_id", "batch_id").agg(F.sum(good).alias("accepted"), F.sum(1 - good).alias("rejected"), F.flatten(F.collect_list(path)).alias("all"))
    errors = F.transform(F.slice(F.sort_array("all"), 1, ERRORS_SHOWN), lambda x: x["error"])
    return out.select("tenant_id", "batch_id", "accepted", "rejected", errors.alias("errors"), (F.size("all") > ERRORS_SHOWN).alias("errors_truncated"))

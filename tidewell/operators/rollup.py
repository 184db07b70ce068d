"""Tumbling-window rollups of points, and their merge algebra.

One aggregate list builds partial rollups from points and another merges rollups; both are associative, so Spark's partial and
final aggregation, batches of a stream, and deltas of a store all combine to the same result (sums up to rounding order).
Histograms are counted sparsely by slot and become vectors only at the end.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import histogram as H
from tidewell.functions.labels import label_hash
from tidewell.functions.windows import end_of, start_of
from tidewell.schema import KEY

SCALARS = ("count", "sum", "min", "max", "last", "last_event_at")
COLUMNS = ("tenant_id", "metric", "kind", "label_hash", "labels", "window_start", "window_end", *SCALARS, "buckets")


def windowed(points: DataFrame, seconds: int) -> DataFrame:
    ts = F.col("timestamp").cast("timestamp")
    return points.withColumns({"timestamp": ts, "label_hash": label_hash(F.col("labels")), "window_start": start_of(ts, seconds)})


def with_occurrence(rows: DataFrame, at: str, value: str) -> DataFrame:
    """``rows`` with ``occurrence``, a number that orders pairs of event time and value: the time above, the bits of the value below.

    A struct would do the same, but cannot live in the buffer of a hash aggregation, which would then sort all rows. The steps are
    columns of their own, so that each is computed once.
    """
    v, two52 = F.col(value), 1 << 52
    rows = rows.withColumn("_a", F.abs(v)).withColumn("_e", F.greatest(F.floor(F.log2("_a")), F.lit(-1022)).cast("double"))
    rows = rows.withColumn("_m", F.col("_a") * F.pow(F.lit(2.0), -F.col("_e")))
    # The logarithm may be off by one next to a power of two.
    rows = rows.withColumn("_by", F.when(F.col("_m") >= 2, 1.0).when((F.col("_m") < 1) & (F.col("_e") > -1022), -1.0).otherwise(0.0))
    size = (F.col("_e") + F.col("_by") + 1022).cast("long") * F.lit(two52) + (F.col("_m") * F.pow(F.lit(2.0), 52 - F.col("_by"))).cast("long")
    rows = rows.withColumn("_size", F.when(F.isnan("_a"), F.lit((1 << 63) - 1)).when(F.col("_a") == float("inf"), F.lit(0x7FF << 52)).when(F.col("_a") == 0, F.lit(0).cast("long")).otherwise(size))
    bits = F.when(v < 0, -F.col("_size")).otherwise(F.col("_size"))
    number = F.unix_micros(at).cast("decimal(20,0)") * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") + bits.cast("decimal(20,0)")
    return rows.withColumn("occurrence", number).drop("_a", "_e", "_m", "_by", "_size")


def _latest(at: str, value: str) -> list:
    return [F.max_by(value, "occurrence").alias("last"), F.max(at).alias("last_event_at"), F.max("occurrence").alias("occurrence")]


def build(points: DataFrame, seconds: int = 60, with_labels: bool = True) -> DataFrame:
    """A rollup per tenant, metric, kind, label set and window.

    ``last`` is the value at the latest event time (microseconds), the larger value on a tie. Two shuffles at most: rows are first
    grouped with their slot (scalars of a slot are partial results), then by series and window, on a few rows per key.
    """
    rows = with_occurrence(windowed(points, seconds), "timestamp", "value")
    slot = F.when(F.col("kind") == "histogram", H.slot(F.col("value")))
    by_slot = rows.groupBy(*KEY, "labels", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), *_latest("timestamp", "value"),
    )
    sparse = F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "count"))))
    out = by_slot.groupBy(*KEY, "labels").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), *_latest("last_event_at", "last"), sparse.alias("sparse"),
    )
    out = out.withColumns({"window_end": end_of(F.col("window_start"), seconds), "buckets": F.when(F.col("kind") == "histogram", H.dense(F.col("sparse")))})
    return out.select(*[c for c in COLUMNS if with_labels or c != "labels"])


def scalars(points: DataFrame, seconds: int = 60) -> DataFrame:
    """Rollups without histograms: one shuffle, no vectors."""
    out = with_occurrence(windowed(points, seconds), "timestamp", "value").groupBy(*KEY, "labels").agg(
        F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), *_latest("timestamp", "value"),
    )
    return out.withColumn("window_end", end_of(F.col("window_start"), seconds)).drop("occurrence")


def averages_in_order(points: DataFrame, seconds: int, place: list[str]) -> DataFrame:
    """(series, labels, window, v): averages whose sums add the values one by one in the order of ``place``.

    For results that show the last bit of a sum, as text rounded at a tie does: sums of doubles depend on the order of their terms,
    and an aggregation adds in the order of its tasks. The running sum holds a row at a time, however many a window has.
    """
    upto = Window.partitionBy(*KEY).orderBy(*place)
    running = upto.rowsBetween(Window.unboundedPreceding, 0)
    rows = windowed(points, seconds).withColumns({"_sum": F.sum("value").over(running), "_count": F.count(F.lit(1)).over(running), "_more": F.lead(F.lit(1)).over(upto)})
    return rows.where(F.col("_more").isNull()).select(*KEY, "labels", (F.col("_sum") / F.col("_count")).alias("v"))


def percentile(points: DataFrame, seconds: int, q: float) -> DataFrame:
    """(series, window, count, v): a quantile per histogram rollup, from its occupied slots; no vector is built."""
    slots = sparse_slots(points, seconds).groupBy(*KEY).agg(F.sum("n").alias("count"), F.sort_array(F.collect_list(F.struct("slot", F.col("n").alias("count")))).alias("entries"))
    return slots.select(*KEY, "count", H.quantile_sparse(F.col("entries"), q).alias("v"))


def merge(*parts: DataFrame) -> DataFrame:
    """Rollups of several parts added up; a revision column, where present, keeps its maximum.

    Occupied slots are added as rows of their own, in the hash aggregation that adds the scalars; a second one gathers the slots
    of a key. Vectors that do not have the 153 slots are left out; a key without any other has none.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    extra = ["revision"] if "revision" in rows.columns else []
    scalar = ["window_end", *SCALARS, *extra, "occurrence"]
    rows = with_occurrence(rows, "last_event_at", "last")
    # The scalars ride with the first slot, or with none where there is no vector; other slots carry nothing else.
    vector = F.when(F.size("buckets") == H.SLOTS, F.col("buckets"))
    rows = rows.select(*KEY, "labels", *scalar, F.posexplode_outer(vector).alias("slot", "n")).where("slot IS NULL OR slot = 0 OR n <> 0")
    first = F.coalesce("slot", F.lit(0)) == 0
    rows = rows.select(*KEY, "labels", *[F.when(first, F.col(c)).alias(c) for c in scalar], "slot", "n", F.when(F.col("slot") == 0, 1).alias("vectors"))

    def added(n):
        top = [F.max(c).alias(c) for c in ("window_end", *extra)]
        return [*top, F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), *_latest("last_event_at", "last"), *n]

    by_slot = rows.groupBy(*KEY, "labels", "slot").agg(*added([F.sum("n").alias("n"), F.sum("vectors").alias("vectors")]))
    entry = F.when(F.col("n") != 0, F.struct("slot", "n"))
    out = by_slot.groupBy(*KEY, "labels").agg(*added([F.map_from_entries(F.collect_list(entry)).alias("sparse"), F.sum("vectors").alias("vectors")]))
    return out.withColumn("buckets", F.when(F.col("vectors") > 0, H.dense(F.col("sparse")))).select(*COLUMNS, *extra)


def sparse_slots(points: DataFrame, seconds: int) -> DataFrame:
    """(series, window, slot, n) of histogram points."""
    rows = windowed(points.where(F.col("kind") == "histogram"), seconds).withColumn("slot", H.slot(F.col("value")))
    return rows.where("slot IS NOT NULL").groupBy(*KEY, "slot").agg(F.count(F.lit(1)).alias("n"))


def statistic(agg: str):
    """A rollup's value for one of the ten aggregations, as a column; null where it has none."""
    if agg in H.QUANTILES:
        return H.quantile(F.col("buckets"), H.QUANTILES[agg])
    if agg == "avg":
        return F.when(F.col("count") == 0, F.lit(0.0)).otherwise(F.col("sum") / F.col("count"))
    return F.col(agg).cast("double")


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value at rank ``ceil(q n)`` of each group, by counting equal values first."""
    from pyspark.sql import Window

    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
    return run.where(F.col("upto") >= F.greatest(F.ceil(F.lit(q) * F.col("all")), F.lit(1))).groupBy(*keys).agg(F.min(value).alias("value"))


def default_aggregation(kind):
    return F.when(kind == "counter", "sum").when(kind == "histogram", "p95").otherwise("last")

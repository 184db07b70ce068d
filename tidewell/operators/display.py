"""What a dashboard derives from answers: gap segments, decimation, CSV, tooltips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["kind", "label_hash"]


def _place(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("t")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c))


def median_delta(points: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Element ``floor(n / 2)`` of the sorted positive gaps of a series, in microseconds; null if there are none."""
    delta = _micros("t") - F.lag(_micros("t")).over(_place(keys))
    counts = points.select(*keys, delta.alias("delta")).where("delta > 0").groupBy(*keys, "delta").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumns({"upto": F.sum("n").over(w.orderBy("delta")), "all": F.sum("n").over(w)})
    return run.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min("delta").alias("interval"))


def segments(points: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """``points`` with ``segment``: a new one begins after a gap over 1.5 times the median."""
    named = median_delta(points, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "interval")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = points.join(named, on, "left").drop(*[f"_{k}" for k in keys])
    delta = _micros("t") - F.lag(_micros("t")).over(_place(keys))
    gap = F.coalesce((delta > F.col("interval") * 1.5).cast("int"), F.lit(0))
    run = F.sum("gap").over(_place(keys).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("gap", gap).withColumn("segment", run).drop("gap", "interval")


def decimate(points: DataFrame, limit: int = 600, keys: list[str] = SERIES) -> DataFrame:
    """At most about ``limit`` points per series: both ends, and each bucket's first minimum and first maximum."""
    rows = points.withColumns({"_rn": F.row_number().over(_place(keys)), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    half = max(1, (limit - 2) // 2)
    width = F.ceil((F.col("_n") - 2) / half)
    inner = (F.col("_rn") > 1) & (F.col("_rn") < F.col("_n"))
    rows = rows.withColumn("_bucket", F.when(inner, F.floor((F.col("_rn") - 2) / width)))
    b = Window.partitionBy(*keys, "_bucket")
    low = F.first("_rn").over(b.orderBy("v", "_rn"))
    high = F.first("_rn").over(b.orderBy(F.col("v").desc(), "_rn"))
    rows = rows.withColumns({"_low": low, "_high": high})
    keep = (F.col("_n") <= limit) | F.col("_bucket").isNull() | (F.col("_rn") == F.col("_low")) | (F.col("_rn") == F.col("_high"))
    return rows.where(keep).drop("_rn", "_n", "_bucket", "_low", "_high")


def csv_cell(c: Column) -> Column:
    """Quoted, quotes doubled, and a leading formula character made text."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"^([=+\-@\t\r])", "'$1"), '"', '""'), F.lit('"'))


def rounded(c: Column, digits: int) -> Column:
    """``c`` times a power of ten, rounded half away from zero, and back: binary rounding, where ``F.round`` rounds the shortest decimal."""
    scaled = c * float(10**digits)
    whole = F.when(scaled < 0, -F.round(-scaled)).otherwise(F.round(scaled)) / float(10**digits)
    return F.when(F.abs(scaled) < float("inf"), whole).otherwise(c)


def csv_number(c: Column) -> Column:
    """A number as quoted text, without an exponent below 1e16; ``c`` is rounded already."""
    plain = F.regexp_replace(c.cast("decimal(38,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.concat(F.lit('"'), F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).otherwise(c.cast("string")), F.lit('"'))


def csv_lines(points: DataFrame, metric: str | Column, labels_json: Column, truncated: bool = False) -> DataFrame:
    """Six quoted columns per point; lines end with CR LF when joined. The header is ``CSV_HEADER``."""
    stamp = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    flag = F.lit('"true"' if truncated else '"false"')
    return points.select("kind", "label_hash", "t", F.concat_ws(",", csv_cell(metric if isinstance(metric, Column) else F.lit(metric)), csv_cell(F.col("kind")), csv_cell(labels_json), csv_cell(stamp), csv_number(F.col("v")), flag).alias("line"))


CSV_HEADER = "metric,kind,labels,window_start,value,truncated"


def csv_text(lines: list[str]) -> str:
    return "\r\n".join([CSV_HEADER, *lines])


def nearest(points: DataFrame, at: Column, keys: list[str] = SERIES) -> DataFrame:
    """The point of each series nearest to an instant; the later one on a tie."""
    return points.groupBy(*keys).agg(F.min_by(F.struct("t", "v"), F.struct(F.abs(_micros("t") - F.unix_micros(at)), -_micros("t"))).alias("p")).select(*keys, "p.t", "p.v")


def number_text(v: float) -> str:
    """Short text of a number: scientific from 1e12 and below 1e-3, compact from 1e4."""
    a = abs(v)
    if a and (a >= 1e12 or a < 1e-3):
        return f"{v:.3e}"
    for size, mark in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if a >= 1e4 and a >= size:
            return f"{v / size:.4g}{mark}"
    return f"{v:.6g}"


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies a table's content: an order-free hash of its rows, computed in parts.

    Each distinct row's hash counts with its multiplicity, and five slices of the hashes are summed, so no task sees all rows.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    rows = df.select(row.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") * F.col("n")).alias(f"s{i}") for i in range(5)]
    return rows.agg(*sums, F.sum("n").alias("rows")).select(F.md5(F.concat_ws(":", *[F.col(f"s{i}").cast("string") for i in range(5)], F.col("rows").cast("string"))).alias("fingerprint"), F.coalesce("rows", F.lit(0)).alias("rows"))

"""Range queries over rollups: scan, row cut, series cap, point cap, ordering, answer document."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import histogram as H
from tidewell.functions import labels as L
from tidewell.operators.rollup import statistic
from tidewell.plans.request import Limits, Request

# Fixed values.
MAX_READ_BYTES = 8 << 20
MAX_CHANGE_BYTES = 256 << 10
MAX_ROWS = 50_001
SCAN_ORDER = ("window_start DESC", "kind", "label_hash")


def in_range(rollups: DataFrame, tenant: str, metric: str, start: datetime, end: datetime, labels: dict[str, str] | None = None) -> DataFrame:
    """Rollups of a tenant's metric whose windows start in [start, end). Plain comparisons, so they reach the Parquet scan."""
    rows = rollups.where((F.col("tenant_id") == tenant) & (F.col("metric") == metric) & (F.col("window_start") >= F.lit(start).cast("timestamp")) & (F.col("window_start") < F.lit(end).cast("timestamp")))
    return rows.where(L.contains(F.col("labels"), labels)) if labels else rows


def scan_order(with_kind: bool = True) -> list[Column]:
    return [F.col("window_start").desc(), *([F.col("kind")] if with_kind else []), F.col("label_hash")]


def scan(rollups: DataFrame, tenant: str, metric: str, start: datetime, end: datetime, labels: dict[str, str] | None = None, limit: int = MAX_ROWS) -> DataFrame:
    """Newest first, cut to ``limit`` rows: a top-k, not a full sort."""
    limit = limit if 0 < limit <= MAX_ROWS else MAX_ROWS
    return in_range(rollups, tenant, metric, start, end, labels).orderBy(*scan_order()).limit(limit)


def scan_plain(rollups: DataFrame, tenant: str, metric: str, start: datetime, end: datetime, limit: int = 1000) -> DataFrame:
    """The older scan: no label filters, and kind is not part of the order (label_hash ties are broken by kind here)."""
    return in_range(rollups, tenant, metric, start, end).orderBy(F.col("window_start").desc(), "label_hash", "kind").limit(limit if limit > 0 else 1000)


def cost(rows: DataFrame) -> Column:
    return L.read_cost(F.col("tenant_id"), F.col("metric"), F.col("kind"), F.col("label_hash"), L.canonical_json(F.col("labels")), F.col("buckets"))


def over_budget(rows: DataFrame, budget: int = MAX_READ_BYTES) -> bool:
    """Whether the rows of a scan exceed the bytes one answer may hold."""
    return (rows.agg(F.sum(cost(rows))).first()[0] or 0) > budget


def shaped(rows: DataFrame, agg: str, max_series: int, max_points: int) -> DataFrame:
    """Kept points (kind, label_hash, labels, t, v) of scanned rows, and ``dropped``: extractable rows that caps removed.

    Rows without the statistic are skipped first. The series cap keeps the series met first in scan order; the point cap
    counts the rows of those series only. Scans are bounded by their row limit, so the windows over them are too.
    """
    order = Window.orderBy(*scan_order())
    series = Window.partitionBy("kind", "label_hash")
    values = rows.withColumn("v", statistic(agg)).where("v IS NOT NULL").withColumn("rank", F.row_number().over(order))
    met = values.withColumn("first", F.min("rank").over(series))
    numbered = met.withColumn("series_no", F.dense_rank().over(Window.orderBy("first")))
    kept = numbered.withColumn("n", F.sum((F.col("series_no") <= max_series).cast("int")).over(order))
    keep = F.col("series_no") <= max_series
    if max_points > 0:
        keep = keep & (F.col("n") <= max_points)
    return kept.select("kind", "label_hash", "labels", F.col("window_start").alias("t"), "v", keep.alias("keep"))


def ordered(points: DataFrame) -> DataFrame:
    """Series by kind and label hash, points by time."""
    return points.where("keep").drop("keep").orderBy(F.concat_ws(":", "kind", "label_hash"), "t")


def kind_of(rows: DataFrame) -> DataFrame:
    """One row: the kind of all scanned rows, or ``mixed``; null if there are none."""
    return rows.agg(F.when(F.count_distinct("kind") > 1, "mixed").otherwise(F.min("kind")).alias("kind"))


def answer(rollups: DataFrame, req: Request, limits: Limits | None = None) -> dict:
    """The answer document: row cut to ``max_points`` first, then the caps on what is left.

    One job: a top-k of at most ``max_points + 1`` rows with their statistic and cost; the caps of ``shaped`` follow on these rows.
    """
    limits = limits or Limits()
    rows = scan(rollups, req.tenant_id, req.metric, req.start, req.end, req.labels, limits.max_points + 1)
    found = rows.select("kind", "label_hash", "labels", F.col("window_start").alias("t"), statistic(req.aggregation).alias("v"), cost(rows).alias("cost")).collect()
    if sum(r["cost"] for r in found) > MAX_READ_BYTES:
        raise ValueError("the query exceeds the read byte budget")
    cut = found[: limits.max_points]
    values = [r for r in cut if r["v"] is not None]
    series: dict[tuple, list] = {}
    points, dropped = 0, False
    for r in values:
        name = (r["kind"], r["label_hash"])
        if name not in series and len(series) < req.max_series:
            series[name] = []
        met = name in series
        points += met
        if met and not 0 < limits.max_points < points:
            series[name].append(r)
        else:
            dropped = True
    stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    shown = [{"kind": p[0]["kind"], "labels": dict(p[0]["labels"] or {}), "points": [(r["t"], r["v"]) for r in sorted(p, key=lambda r: r["t"])]} for _, p in sorted(series.items(), key=lambda x: f"{x[0][0]}:{x[0][1]}") if p]
    kinds = {r["kind"] for r in cut}
    kind = None if not kinds else min(kinds) if len(kinds) == 1 else "mixed"
    out = {"metric": req.metric, "agg": req.aggregation, "kind": kind, "from": stamp(req.start), "to": stamp(req.end), "series": shown, "truncated": len(found) > limits.max_points or dropped}
    if req.aggregation in H.QUANTILES and len(values) < len(cut):
        out["warnings"] = [f"{req.aggregation} is only available for histogram metrics; windows without a histogram were omitted"]
    return out


def answer_json(document: dict) -> str:
    """An answer as JSON: times in RFC 3339, no NaN or infinities."""

    def plain(x):
        if isinstance(x, datetime):
            return x.strftime("%Y-%m-%dT%H:%M:%S.%fZ").replace(".000000Z", "Z")
        raise TypeError(type(x).__name__)

    return json.dumps(document, default=plain, allow_nan=False, ensure_ascii=False, separators=(",", ":"))


def stream_events(rollups: DataFrame) -> DataFrame:
    """What a live tail sends: scalars only, no buckets and no percentiles."""
    avg = F.when(F.col("count") == 0, 0.0).otherwise(F.col("sum") / F.col("count"))
    return rollups.select("metric", "kind", "labels", "window_start", "window_end", "count", "sum", avg.alias("avg"), "min", "max", "last")


def sse_frames(rollups: DataFrame) -> DataFrame:
    """(frame): text frames of a server-sent event stream, in keyset order where rollups have a revision."""
    order = ["revision"] if "revision" in rollups.columns else []
    rows = stream_events(rollups.orderBy(*order, "metric", "kind", "label_hash", "window_start"))
    body = F.to_json(F.struct(*rows.columns))
    return rows.select(F.concat(F.lit("event: rollup\ndata: "), body, F.lit("\n\n")).alias("frame"))


def matches(events: DataFrame, metric: str, labels: dict[str, str]) -> DataFrame:
    return events.where((F.col("metric") == metric) & L.contains(F.col("labels"), labels))


def search(series: DataFrame, text: str) -> DataFrame:
    """Series whose kind or labels contain a text, in any case."""
    return series.where(F.lower(F.concat_ws(" ", "kind", L.canonical_json(F.col("labels")))).contains(text.lower()))

"""Listings: metrics, label keys, label values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.labels import has_key
from tidewell.plans.request import capped


def metrics(rollups: DataFrame, tenant: str, limit: int = 1000) -> DataFrame:
    """Per metric and kind the number of series, and the oldest and newest window."""
    rows = rollups.where(F.col("tenant_id") == tenant).groupBy("metric", "kind")
    out = rows.agg(F.count_distinct("label_hash").alias("series_count"), F.min("window_start").alias("oldest"), F.max("window_start").alias("newest"))
    return out.orderBy("metric", "kind").limit(capped(limit, 1000))


def label_keys(rollups: DataFrame, tenant: str, metric: str, limit: int = 500) -> DataFrame:
    rows = rollups.where((F.col("tenant_id") == tenant) & (F.col("metric") == metric))
    return rows.select(F.explode(F.map_keys("labels")).alias("key")).distinct().orderBy("key").limit(capped(limit, 500))


def label_values(rollups: DataFrame, tenant: str, metric: str, key: str, limit: int = 1000) -> DataFrame:
    """Distinct values in binary order."""
    rows = rollups.where((F.col("tenant_id") == tenant) & (F.col("metric") == metric) & has_key(F.col("labels"), key))
    return rows.select(F.element_at("labels", F.lit(key)).alias("value")).distinct().orderBy("value").limit(capped(limit, 1000))


def metric_names(rollups: DataFrame, tenant: str, limit: int = 500) -> DataFrame:
    return rollups.where(F.col("tenant_id") == tenant).select("metric").distinct().orderBy("metric").limit(limit if limit > 0 else 500)


def series_stats(points: DataFrame, keys: tuple[str, ...] = ("kind", "label_hash")) -> DataFrame:
    """Latest value, extremes and count per series, for display."""
    return points.groupBy(*keys).agg(F.max_by("v", "t").alias("latest"), F.min("v").alias("min"), F.max("v").alias("max"), F.count(F.lit(1)).alias("n"))

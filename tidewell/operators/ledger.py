"""Delivery dedup: which (batch, window) pairs count, and which are counted already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.windows import start_of

PAIR = ["tenant_id", "batch_id", "window_start"]


def claims(points: DataFrame, seconds: int = 60) -> DataFrame:
    """The distinct windows of each batch."""
    return points.withColumn("window_start", start_of(F.col("timestamp"), seconds)).select(*PAIR).distinct()


def first_delivery(points: DataFrame) -> DataFrame:
    """One copy of each point of a batch, however often the batch was delivered."""
    return points.dropDuplicates(["tenant_id", "batch_id", "idx"])


def uncommitted(points: DataFrame, ledger: DataFrame, seconds: int = 60) -> DataFrame:
    """Points whose (batch, window) the ledger does not have yet."""
    rows = points.withColumn("window_start", start_of(F.col("timestamp"), seconds))
    return rows.join(ledger.select(*PAIR), PAIR, "left_anti").drop("window_start")


def reserve(requests: DataFrame, reservations: DataFrame) -> DataFrame:
    """``requests`` (tenant_id, idempotency_key, fingerprint, at) with ``outcome``: new, replay or conflict.

    The newest reservation of a key counts while ``expires_at`` is after the request; an expired one is replaced.
    """
    last = reservations.groupBy("tenant_id", "idempotency_key").agg(F.max_by(F.struct("fingerprint", "expires_at", "response"), "created_at").alias("r"))
    rows = requests.join(last, ["tenant_id", "idempotency_key"], "left")
    live = F.coalesce(F.col("r.expires_at") > F.col("at"), F.lit(False))
    outcome = F.when(~live, "new").when(F.col("r.fingerprint") == F.col("fingerprint"), "replay").otherwise("conflict")
    return rows.select(*requests.columns, outcome.alias("outcome"), F.when(outcome == "replay", F.col("r.response")).alias("response"))


def key_ok(key):
    """Idempotency keys: 1 to 255 visible ASCII characters."""
    return F.coalesce(key.rlike(r"^[\x21-\x7e]{1,255}\z"), F.lit(False))


def fingerprint(body):
    return F.sha2(body, 256)


def completed(reservations: DataFrame) -> DataFrame:
    """A completed reservation keeps its answer but not its points."""
    return reservations.withColumn("batch", F.when(F.col("published"), F.lit(None).cast("string")).otherwise(F.col("batch")))

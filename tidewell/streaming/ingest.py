"""Streams of envelopes into a store, and watermark-closed windows.

The default is additive: every micro-batch is folded into partial rollups and committed with its claims; late points correct
windows that were written before, and nothing is dropped. A micro-batch that runs twice finds its claims and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.functions import validate as V
from tidewell.functions.labels import label_hash
from tidewell.functions.windows import start_of
from tidewell.operators import ledger, rollup
from tidewell.plans.store import Conflict, Store
from tidewell.schema import SERIES
from tidewell.sources import points as P


#: Tenants that commit at a time.
COMMITS = 4
#: Session setting: false for one watermark for late rows and closing.
ONE_WATERMARK = "spark.sql.streaming.statefulOperator.allowMultiple"


def fold(store: Store, points: DataFrame, seconds: int, now: datetime, attempts: int = 3) -> dict[str, int]:
    """Commit the points that the ledger does not have; returns the revision per tenant. Tenants commit independently, some at a time."""
    points = ledger.first_delivery(points).persist()

    def commit(tenant: str, first: datetime, last: datetime) -> int:
        own = points.where(F.col("tenant_id") == tenant)
        for attempt in range(attempts):
            fresh = ledger.uncommitted(own, store.ledger(tenant, first, last), seconds)
            try:
                return store.commit(tenant, rollup.build(fresh, seconds), ledger.claims(fresh, seconds), now)
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise AssertionError("no attempts")

    try:
        window = start_of(F.col("timestamp").cast("timestamp"), seconds)
        found = points.groupBy("tenant_id").agg(F.min(window).alias("first"), F.max(window).alias("last")).collect()
        with ThreadPoolExecutor(min(COMMITS, len(found) or 1)) as pool:
            done = {r["tenant_id"]: pool.submit(commit, r["tenant_id"], r["first"], r["last"]) for r in sorted(found)}
            return {tenant: f.result() for tenant, f in done.items()}
    finally:
        points.unpersist()


def into_store(envelopes: DataFrame, store: Store, quarantine: str, checkpoint: str, seconds: int = 60, clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> DataStreamWriter:
    """A writer that decodes envelopes, sets permanent failures aside, and folds the rest."""

    def each(batch: DataFrame, _: int) -> None:
        decoded = P.decode_envelopes(batch).persist()
        try:
            bad = P.quarantine(decoded)
            if not bad.isEmpty():
                bad.write.mode("append").parquet(quarantine)
            fold(store, V.normalise(P.envelope_points(decoded)), seconds, clock())
        finally:
            decoded.unpersist()

    return envelopes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def closed_windows(points: DataFrame, seconds: int, lateness: timedelta) -> DataFrame:
    """Windows that the watermark has closed, each once (append mode); points later than that are dropped.

    Spark moves the watermark after a micro-batch. By default windows close with the new one while late rows are told by the one
    before, so a late row of the very next batch still counts where its window is open; with ``ONE_WATERMARK`` set to false
    in the session, which allows one stateful operator a query, both use the new one.
    """
    rows = points.withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "label_hash": label_hash(F.col("labels"))})
    w = F.window("timestamp", f"{seconds} seconds")
    out = rows.withWatermark("timestamp", f"{int(lateness.total_seconds() * 1000)} milliseconds").groupBy(*SERIES, w.alias("w")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.max(F.struct("timestamp", "value")).alias("latest")
    )
    return out.select(*SERIES, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", "sum", "min", "max", F.col("latest.value").alias("last"), F.col("latest.timestamp").alias("last_event_at"))


class Tumbling:
    """Open windows of one key with a per-point watermark; after silence only the oldest window is closed."""

    def __init__(self, micros: int, lateness: int, state: tuple | None = None):
        self.size, self.lateness = micros, lateness
        self.watermark, starts, counts, sums = state or (None, [], [], [])
        self.open = {s: [n, t] for s, n, t in zip(starts, counts, sums, strict=True)}

    def add(self, at: int, value: float) -> None:
        self.watermark = max(self.watermark if self.watermark is not None else at - self.lateness, at - self.lateness)
        start = at - at % self.size
        if start + self.size > self.watermark:
            seen = self.open.setdefault(start, [0, 0.0])
            seen[0] += 1
            seen[1] += value

    def idle(self) -> None:
        if self.open:
            self.watermark = max(self.watermark, min(self.open) + self.size)

    def close(self) -> list[tuple[int, int, float]]:
        """(start, count, sum) of the windows that the watermark has passed."""
        out = [(s, *self.open.pop(s)) for s in sorted(self.open) if s + self.size <= self.watermark]
        return out

    def state(self) -> tuple:
        s = sorted(self.open)
        return self.watermark, s, [self.open[x][0] for x in s], [self.open[x][1] for x in s]


def idle_windows(points: DataFrame, seconds: int, lateness: timedelta, idle: timedelta) -> DataFrame:
    """Windows of each tenant and metric, closed by the watermark, or after ``idle`` of silence one after the other.

    For processing-time triggers: ``availableNow`` does not end while a timeout is pending.
    """
    size, late, wait = seconds * 1_000_000, int(lateness.total_seconds() * 1e6), int(idle.total_seconds() * 1000)

    def each(key: tuple, frames, state: GroupState):
        t = Tumbling(size, late, state.getOption)
        if state.hasTimedOut:
            t.idle()
        else:
            for f in frames:
                for at, v in zip(f["at"], f["value"], strict=True):
                    t.add(int(at), float(v))
        done = t.close()
        state.update(t.state())
        if t.open:
            state.setTimeoutDuration(wait)
        if done:
            yield pd.DataFrame([(*key, pd.Timestamp(s, unit="us"), n, x) for s, n, x in done], columns=["tenant_id", "metric", "window_start", "count", "sum"])

    rows = points.select("tenant_id", "metric", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), "value")
    return rows.groupBy("tenant_id", "metric").applyInPandasWithState(
        each, "tenant_id string, metric string, window_start timestamp, count long, sum double", "watermark long, starts array<long>, counts array<long>, sums array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )

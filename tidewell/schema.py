"""Row schemas of the engine."""

from __future__ import annotations

POINT = "tenant_id string, batch_id string, received_at timestamp, idx int, metric string, kind string, value double, timestamp timestamp, labels map<string,string>"
ROLLUP = (
    "tenant_id string, metric string, kind string, label_hash string, labels map<string,string>, window_start timestamp, window_end timestamp, count bigint, "
    "sum double, min double, max double, last double, last_event_at timestamp, buckets array<bigint>"
)
LEDGER = "tenant_id string, batch_id string, window_start timestamp"
POINT_JSON = "metric: string, kind: string, value: double, timestamp: string, labels: map<string,string>"
ENVELOPE = f"schema_version string, batch_id string, tenant_id string, received_at string, points array<struct<{POINT_JSON}>>"
SERIES = ("tenant_id", "metric", "kind", "label_hash")
KEY = (*SERIES, "window_start")

"""Query requests: parameters in, a validated request or every violation out. Plain Python on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

# Fixed values.
AGGREGATIONS = ("sum", "count", "avg", "min", "max", "last", "p50", "p90", "p95", "p99")
PRESETS = {"15m": timedelta(minutes=15), "1h": timedelta(hours=1), "6h": timedelta(hours=6), "24h": timedelta(hours=24)}
_UNITS = {"ns": 1e-3, "us": 1.0, "µs": 1.0, "μs": 1.0, "ms": 1e3, "s": 1e6, "m": 6e7, "h": 3.6e9}
_METRIC = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_RFC3339 = re.compile(r"(\d{4}-\d{2}-\d{2})[T](\d{2}:\d{2}:\d{2})([.,]\d+)?(Z|[+-]\d{2}:\d{2})")


@dataclass(frozen=True)
class Limits:
    max_range: timedelta = timedelta(days=31)
    max_series: int = 500
    max_points: int = 50_000
    default_range: timedelta = timedelta(hours=1)


@dataclass(frozen=True)
class Request:
    tenant_id: str
    metric: str
    aggregation: str
    start: datetime
    end: datetime
    labels: dict[str, str] = field(default_factory=dict)
    max_series: int = 500


def duration(text: str) -> timedelta:
    """A signed sequence of decimal numbers with units, such as -1h30m; days are not a unit."""
    m = re.fullmatch(r"([+-]?)((?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h))+", text)
    if text in ("0", "+0", "-0"):
        return timedelta(0)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    micros = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)", text))
    return timedelta(microseconds=-micros if m[1] == "-" else micros)


def instant(text: str) -> datetime:
    m = _RFC3339.fullmatch(text)
    if not m:
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    zone = "+00:00" if m[4] == "Z" else m[4]
    fraction = f".{m[3][1:7]:0<6}" if m[3] else ""
    return datetime.fromisoformat(f"{m[1]}T{m[2]}{fraction}{zone}").astimezone(UTC)


def _when(name: str, raw: str, fallback: datetime, anchor: datetime, out: list) -> datetime:
    raw = raw.strip()
    if not raw:
        return fallback
    try:
        return anchor + duration(raw) if raw.startswith("-") else instant(raw)
    except (ValueError, OverflowError) as e:
        out.append((name, str(e)))
        return fallback


def parse(tenant: str, params: dict[str, list[str] | str], now: datetime, limits: Limits | None = None) -> tuple[Request, list[tuple[str, str]]]:
    """``params`` as in a query string: metric, agg, from, to, and ``label.<key>`` filters; the first of repeated values counts."""
    limits = limits or Limits()
    one = {k: (v if isinstance(v, str) else v[0] if v else "") for k, v in params.items()}
    bad: list[tuple[str, str]] = []
    metric = one.get("metric", "").strip()
    if not metric:
        bad.append(("metric", "is required"))
    elif len(metric.encode()) > 200 or not _METRIC.fullmatch(metric):
        bad.append(("metric", "is not a metric name"))
    agg = "avg"
    if raw := one.get("agg", ""):
        if raw.strip().lower() in AGGREGATIONS:
            agg = raw.strip().lower()
        else:
            bad.append(("agg", f"{raw!r} is not one of {', '.join(AGGREGATIONS)}"))
    now = now.astimezone(UTC)
    end = _when("to", one.get("to", ""), now, now, bad)
    start = _when("from", one.get("from", ""), end - limits.default_range, end, bad)
    if end <= start:
        bad.append(("from", "must be before to"))
    elif end - start > limits.max_range:
        bad.append(("from", f"range exceeds {limits.max_range}"))
    labels = {k[6:]: v for k, v in one.items() if k.startswith("label.")}
    for k, v in sorted(labels.items()):
        if not _KEY.fullmatch(k):
            bad.append((f"label.{k}", "is not a label key"))
        if len(v.encode()) > 256:
            bad.append((f"label.{k}", "value is too long"))
    return Request(tenant, metric, agg, start, end, labels, limits.max_series), bad


def limit_of(raw: str | None, fallback: int = 500) -> int:
    """A positive integer, or the fallback."""
    try:
        n = int(raw or "")
    except ValueError:
        return fallback
    return n if n > 0 else fallback


def capped(limit: int, cap: int) -> int:
    """Listing limits: out of 1..cap means the cap."""
    return limit if 0 < limit <= cap else cap


def display_range(preset: str, now: datetime, start: datetime | None = None, end: datetime | None = None) -> tuple[datetime, datetime]:
    """A preset range, or a custom one of at most 744 hours."""
    if preset in PRESETS:
        return now - PRESETS[preset], now
    if preset != "custom" or start is None or end is None or not start < end or end - start > timedelta(hours=744):
        raise ValueError("choose a preset, or a start before an end within 744 hours")
    return start, end


def display_filters(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """At most 20 label filters with distinct, unreserved keys."""
    out: dict[str, str] = {}
    for k, v in pairs:
        if not _KEY.fullmatch(k) or len(k.encode()) > 64 or k.startswith("__") or len(v.encode()) > 256 or k in out:
            raise ValueError(f"bad label filter {k!r}")
        out[k] = v
    if len(out) > 20:
        raise ValueError("at most 20 label filters")
    return out

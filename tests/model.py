"""A plain Python model of accumulation and of answers, for comparison."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

from tidewell.functions.histogram import BUCKETS, GROWTH, LEAST


def label_hash(labels: dict[str, str]) -> str:
    raw = "".join(f"{len(x.encode())}:{x}" for k in sorted(labels, key=str.encode) for x in (k, labels[k]))
    return hashlib.sha256(raw.encode()).hexdigest()[:32]


def slot(v: float) -> int | None:
    if math.isnan(v):
        return None
    if v <= 0:
        return 0 if v < 0 else 1
    if v <= LEAST:
        return 2
    if math.isinf(v):
        return BUCKETS + 2
    return min(max(int((math.log(v) - math.log(LEAST)) / math.log(GROWTH)), 0), BUCKETS) + 2


@dataclass
class Acc:
    count: int = 0
    sum: float = 0.0
    min: float = math.inf
    max: float = -math.inf
    latest: tuple = ()
    slots: list[int] = field(default_factory=lambda: [0] * (BUCKETS + 3))

    def add(self, ts, v):
        self.count += 1
        self.sum += v
        self.min, self.max = min(self.min, v), max(self.max, v)
        self.latest = max(self.latest, (ts, v)) if self.latest else (ts, v)
        if (s := slot(v)) is not None:
            self.slots[s] += 1


def build(rows, max_series, max_points):
    """Rows (kind, hash, t, v or None) in scan order; the library-level caps with their break."""
    groups, total, truncated, kind = {}, 0, False, None
    for k, h, t, v in rows:
        kind = k if kind in (None, k) else "mixed"
        if v is None:
            continue
        if max_points > 0 and total >= max_points:
            truncated = True
            break
        if (k, h) not in groups:
            if len(groups) >= max_series:
                truncated = True
                continue
            groups[k, h] = []
        groups[k, h].append((t, v))
        total += 1
    return {g: sorted(p) for g, p in groups.items()}, truncated, kind

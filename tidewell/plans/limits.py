"""Token buckets: how many points a tenant may send. Plain Python on the driver, with the time given."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Buckets:
    """A bucket per key that holds ``burst`` tokens and gains ``rate`` a second; idle keys are forgotten once they are full."""

    rate: float
    burst: float
    held: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self):
        if not self.rate > 0 or not self.burst > 0:
            raise ValueError("rate and burst must be positive")

    def _now(self, key: str, at: float) -> float:
        tokens, since = self.held.get(key, (self.burst, at))
        return min(self.burst, tokens + max(0.0, at - since) * self.rate)

    def take(self, key: str, n: float, at: float) -> float:
        """0 if ``n`` tokens were taken, else the seconds until they would be there; more than ``burst`` never are."""
        have = self._now(key, at)
        if n <= have:
            self.held[key] = (have - n, max(at, self.held.get(key, (0.0, at))[1]))
            return 0.0
        return float("inf") if n > self.burst else (n - have) / self.rate

    def forget(self, at: float) -> int:
        full = [k for k in self.held if self._now(k, at) >= self.burst]
        for k in full:
            del self.held[k]
        return len(full)

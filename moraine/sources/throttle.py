"""Token buckets for writers that have to keep to a rate (SC09)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class TokenBucket:
    """At most ``most`` tokens, refilled evenly so that ``most`` come in ``unit`` seconds."""

    most: float
    unit: float = 1.0
    tokens: float | None = None
    last: float | None = None

    def wait(self, now: float, wanted: float) -> float:
        """Seconds to wait before ``wanted`` tokens may be used; the deficit is taken at once."""
        held = self.most if self.tokens is None else self.tokens
        if self.last is not None:
            held = min(self.most, held + self.most * max(0.0, now - self.last) / self.unit)
        self.tokens, self.last = held - wanted, now
        return max(0.0, -self.tokens) / self.most * self.unit

"""Retry delays, durations and handler outcomes."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the longest duration, in seconds.
MAX_SECONDS = 9_007_199_254_740


def milliseconds(seconds: float) -> int:
    """Seconds as whole milliseconds, truncated; no booleans, negative or non-finite numbers."""
    if isinstance(seconds, bool) or not isinstance(seconds, (int, float)):
        raise TypeError("a duration must be a number")
    if not math.isfinite(seconds) or seconds < 0 or seconds > MAX_SECONDS:
        raise ValueError("a duration must be finite, not negative and not too long")
    return int(seconds * 1000)


@dataclass(frozen=True)
class RetryPolicy:
    """Fixed or capped exponential delays; the attempt is one-based."""

    max_attempts: int
    initial_delay: float
    multiplier: float = 1.0
    max_delay: float = math.inf
    jitter: bool = False

    def __post_init__(self):
        if isinstance(self.max_attempts, bool) or self.max_attempts < 1:
            raise ValueError(f"at least one attempt is needed, not {self.max_attempts!r}")
        milliseconds(self.initial_delay)
        if not math.isfinite(self.multiplier) or self.multiplier < 1:
            raise ValueError(f"delays can't shrink or be infinite: multiplier {self.multiplier!r}")
        if self.max_delay < self.initial_delay:
            raise ValueError("max_delay must be at least initial_delay")

    @classmethod
    def fixed(cls, max_attempts: int, delay: float) -> RetryPolicy:
        return cls(max_attempts, delay)

    @classmethod
    def exponential(cls, max_attempts: int, initial_delay: float, multiplier: float = 2.0, max_delay: float = 60.0, jitter: bool = False) -> RetryPolicy:
        if multiplier <= 1:
            raise ValueError("multiplier must be greater than 1")
        return cls(max_attempts, initial_delay, multiplier, max_delay, jitter)

    def _last_power(self) -> float:
        """The attempt from which on the delay is max_delay; told in logarithms, so that no power overflows."""
        if self.initial_delay == 0 or self.multiplier == 1 or self.max_delay == math.inf:
            return math.inf
        return 1 + (math.log(self.max_delay) - math.log(self.initial_delay)) / math.log(self.multiplier)

    def seconds(self, attempt: int, uniform=random.uniform) -> float:
        """The delay after an attempt; with jitter one draw between 0 and it."""
        rise = (attempt - 1) * math.log(self.multiplier)
        if attempt >= self._last_power():
            base = self.max_delay
        elif rise < 700:
            base = min(self.initial_delay * self.multiplier ** (attempt - 1), self.max_delay)
        else:  # the power alone is too large for a double
            base = min(math.exp(math.log(self.initial_delay) + rise), self.max_delay)
        return uniform(0.0, base) if self.jitter else float(base)

    def delay(self, attempt: Column, uniform: Column | None = None) -> Column:
        """The same for many attempts; uniform in [0, 1) is the draw, without one there is no jitter."""
        first, most = F.lit(float(self.initial_delay)), F.lit(float(self.max_delay))
        rise = (attempt - 1).cast("double") * math.log(self.multiplier)
        power = first if self.initial_delay == 0 else F.when(rise < 700, first * F.pow(F.lit(float(self.multiplier)), (attempt - 1).cast("double"))).otherwise(F.exp(math.log(self.initial_delay) + rise))
        base = F.when(attempt >= F.lit(self._last_power()), most).otherwise(F.least(power, most))
        return base * uniform if self.jitter and uniform is not None else base


class Retry(Exception):
    """Raised by a handler: try again, after a time of its own if given."""

    def __init__(self, reason: str | None = None, *, after: float | None = None):
        super().__init__(reason or "")
        self.reason, self.after = reason, None if after is None else milliseconds(after) / 1000


class Reject(Exception):
    """Raised by a handler: fail for good."""

    def __init__(self, reason: str | None = None, *, category: str | None = None):
        super().__init__(reason or "")
        self.reason, self.category = reason, category


def error_text(error: BaseException) -> str:
    return str(error) or type(error).__name__

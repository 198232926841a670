"""Forgetting-curve expressions. ``now`` is always passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.config import DEFAULTS
from engram.schemas import PINNED


def elapsed_hours(since: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(since)) / F.lit(3.6e9)


def stability_or_default(stability: Column, default: float = DEFAULTS.default_stability_days) -> Column:
    """-1 pins a fact; every other value that is not positive takes the default."""
    return F.when((stability > 0) | (stability == PINNED), stability).otherwise(F.lit(default))


def retention(stability: Column, last_accessed: Column, now: Column) -> Column:
    """exp(-t/S); a pinned fact keeps 1."""
    curve = F.exp(-elapsed_hours(last_accessed, now) / (F.lit(24.0) * stability))
    return F.when(stability == PINNED, 1.0).otherwise(curve)


def reinforced_stability(
    stability: Column,
    times: Column | int = 1,
    default: float = DEFAULTS.default_stability_days,
    factor: float = DEFAULTS.reinforce_factor,
    cap: float = DEFAULTS.max_stability_days,
) -> Column:
    """Stability after a number of accesses; the cap commutes with the steps."""
    times = F.lit(times) if isinstance(times, int) else times
    base = F.when(stability > 0, stability).otherwise(F.lit(default))
    grown = F.least(base * F.pow(F.lit(factor), times), F.lit(cap))
    return F.when((stability == PINNED) | (times == 0), stability).otherwise(grown)

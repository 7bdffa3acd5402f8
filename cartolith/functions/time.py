"""Time on columns; timestamps with and without zone alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970; a timestamp without zone is read in the session's zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def seconds(ts: Column | str) -> Column:
    return micros(ts) / F.lit(1e6)


def until(now: Column, ttl_s: Column) -> Column:
    """The time ttl_s seconds from now; now is passed in, so a rerun gives the same."""
    return now + F.make_dt_interval(secs=ttl_s)


def stale(source: Column, current_source: Column, made_at: Column, now: Column, most_h: int = 24) -> Column:
    """The reason that a product is stale: its source changed, or it is older than most_h hours; null if it isn't."""
    return F.when(~source.eqNullSafe(current_source), "source changed").when(micros(now) - micros(made_at) > most_h * 3_600_000_000, "too old")


def clamped_delay(delay: Column, low: float = 0.12, high: float = 2.5) -> Column:
    """A delay between low and high; null, not a number and negative ones count as low."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.nanvl(F.coalesce(delay, F.lit(low)), F.lit(low))))

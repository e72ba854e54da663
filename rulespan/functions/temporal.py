"""Time in epoch milliseconds. Whatever is no long gives null; sums that overflow stop at the ends of long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Typed, function, takes


def _ends(found: Column, negative: Column, given: Column) -> Column:
    end = F.when(negative, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
    return F.when(given.isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce(found, end))


def plus(a: Column, b: Column) -> Column:
    return _ends(F.try_add(a, b), a < 0, F.when(a.isNotNull(), b))


def minus(a: Column, b: Column) -> Column:
    return _ends(F.try_subtract(a, b), a < 0, F.when(a.isNotNull(), b))


@function(0)
def time_now() -> Typed:
    """The time the query started, the same in all its rows."""
    return Typed(F.unix_millis(F.current_timestamp()), "long")


for _name in ("time_diff", "time_sub"):
    takes("ts ts", "long", _name)(minus)
takes("ts ts", "long", "time_add")(plus)
takes("ts ts", "long", "interval_duration")(lambda s, e: minus(e, s))


@takes("ts ts ts", "double", "time_decay")
def time_decay(ts: Column, now: Column, half: Column) -> Column:
    """Halves with each half-life; 1 for no age. No positive half-life: 1 for no age, else 0."""
    age = minus(now, ts)
    return F.when(age <= 0, F.lit(1.0)).when(half <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(0.5), age.cast("double") / F.when(half > 0, half).cast("double")))


@takes("ts ts ts", "double", "time_decay_linear")
def time_decay_linear(ts: Column, now: Column, most: Column) -> Column:
    """Falls from 1 to 0 over `most`."""
    age = minus(now, ts)
    return F.when(age <= 0, F.lit(1.0)).when(most <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - age.cast("double") / F.when(most > 0, most).cast("double")))


takes("ts ts", "boolean", "time_before")(lambda a, b: a < b)
takes("ts ts", "boolean", "time_after")(lambda a, b: a > b)
takes("ts ts ts", "boolean", "time_between")(lambda t, s, e: (t >= s) & (t <= e))
takes("ts ts ts", "boolean", "point_in_interval")(lambda t, s, e: (t >= s) & (t <= e))
takes("ts ts ts", "boolean", "within_last")(lambda t, now, d: minus(now, t).between(F.lit(0), d))
takes("ts ts ts ts", "boolean", "intervals_overlap")(lambda a, b, c, d: (a <= d) & (c <= b))
takes("ts ts ts ts", "boolean", "interval_contains")(lambda a, b, c, d: (a <= c) & (d <= b))

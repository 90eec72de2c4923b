"""ISO weeks and ages. No function here reads the clock; the time of reference is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(ts: str | Column) -> Column:
    """YYYY-Www by the ISO year."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def week_index(ts: str | Column) -> Column:
    """Number of the week's Monday, so that neighbouring weeks differ by one."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.datediff(F.to_date(F.date_trunc("week", ts)), F.lit("0001-01-01").cast("date")) / 7).cast("long")


def age_days(as_of: Column, ts: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000).cast("long")


#: Weights are kept as whole numbers of 1/730, so that sums don't depend on their order.
WEIGHT_UNIT = 730


def age_weight_units(age: Column) -> Column:
    """Twice the weight under 30 days, then falling over a year to a half."""
    return F.when(age < 30, 2 * WEIGHT_UNIT).otherwise(F.greatest(F.lit(WEIGHT_UNIT // 2), WEIGHT_UNIT - 2 * (age - 30))).cast("long")

"""Dates, backoff, and months of experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recency_bonus(ts: Column, as_of: Column) -> Column:
    """10, 7, 4 or 2 points up to a week, a month, a quarter, a year; a future date counts as today."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86400e6)
    return F.when(ts.isNull(), 0).when(days <= 7, 10).when(days <= 30, 7).when(days <= 90, 4).when(days <= 365, 2).otherwise(0)


def backoff_minutes(attempts: Column) -> Column:
    return F.least(F.lit(360), F.greatest(F.lit(1), F.pow(F.lit(2), F.least(F.lit(8), F.greatest(F.lit(0), attempts - 1))).cast("int")))


def month_index(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def covered_months(spans: Column) -> Column:
    """Months covered by half-open intervals, an array of (s, e) sorted by start; touching ones are one."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("reach"))

    def step(acc, x):
        return F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], x["e"]).alias("reach"))

    return F.aggregate(spans, zero, step, lambda a: a["n"]).cast("long")


def union_months(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Months covered by each key's half-open intervals; touching ones are one. Sorted within the key's row."""
    spans = F.array_sort(F.collect_set(F.struct(F.col(start).alias("s"), F.col(end).alias("e"))))
    return df.groupBy(key).agg(covered_months(spans).alias("months"))


def safe_timestamp(c: Column) -> Column:
    """ISO-like text, or milliseconds since the epoch; anything else is null."""
    iso = F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"), F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" "))))
    return F.coalesce(iso, F.when(c.rlike("^[0-9]{12,13}$"), F.timestamp_millis(F.try_to_number(c, F.lit("9999999999999")).cast("long"))))

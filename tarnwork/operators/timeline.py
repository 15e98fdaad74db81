"""Dated events of several kinds in one stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.dates import period_start


def overlaps_period(since: Column, onset: str, end: str, ongoing: str) -> Column:
    """An interval that begins in the period, goes on, or ends in it."""
    return since.isNull() | (F.to_date(onset) >= since) | F.col(ongoing) | F.coalesce(F.to_date(end) >= since, F.lit(False))


def timeline(kinds: dict[str, DataFrame], *, today: Column, period: str = "all") -> DataFrame:
    """``tenant, day, kind, text`` of ``kinds``, each ``(tenant, day, text)``, from the period's first day on.

    There is no upper end: days to come stay.
    """
    since = period_start(today, period)
    rows = [df.select("tenant", F.col("day").cast("date").alias("day"), F.lit(kind).alias("kind"), "text") for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, rows).where(since.isNull() | (F.col("day") >= since))


def timeline_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant", "kind").agg(F.count("*").alias("n"))


def timeline_text(events: DataFrame) -> DataFrame:
    """One text by tenant: a line for each day, in order, with its events after each other."""
    days = events.groupBy("tenant", "day").agg(F.array_join(F.sort_array(F.collect_list("text")), "; ").alias("line"))
    lines = F.sort_array(F.collect_list(F.struct("day", F.concat_ws(": ", F.col("day").cast("string"), "line").alias("line"))))
    return days.groupBy("tenant").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))

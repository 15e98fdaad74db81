"""Measurements over time: one unit for a series, alignment, trends, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.numbers import comparable_number, convert_range, convert_value
from tarnwork.functions.units import normalize_unit
from tarnwork.session import small


def dominant_unit(results: DataFrame, *, series: list[str], unit: str, order: list[str], default: Column | None = None) -> DataFrame:
    """``series, unit_key, unit_label`` by series: the commonest unit; the default one, else the first seen, wins a tie.

    The label is the commonest printed spelling of that unit. Series without any unit have no row.
    """
    printed = results.select(*series, F.trim(unit).alias("_unit"), F.struct(*order).alias("_order"), (default if default is not None else F.lit(None).cast("string")).alias("_default")).where("_unit <> ''")
    printed = printed.groupBy(*series, "_unit", "_default").agg(F.count("*").alias("_n"), F.min("_order").alias("_seen"))
    # Units are normalised by spelling, not by row.
    keyed = printed.withColumn("unit_key", normalize_unit("_unit")).withColumn("_default", normalize_unit("_default")).where("unit_key <> ''")
    spelled = keyed.groupBy(*series, "unit_key", "_unit").agg(F.sum("_n").alias("_n"), F.min("_seen").alias("_seen"), F.max(F.coalesce(F.col("unit_key") == F.nullif("_default", F.lit("")), F.lit(False))).alias("_is_default"))
    by_seen = Window.partitionBy(*series, "unit_key").orderBy(F.desc("_n"), "_seen")
    labelled = spelled.withColumn("_rank", F.row_number().over(by_seen))
    units = labelled.groupBy(*series, "unit_key").agg(F.sum("_n").alias("_n"), F.min("_seen").alias("_seen"), F.max("_is_default").alias("_is_default"), F.max(F.when(F.col("_rank") == 1, F.col("_unit"))).alias("unit_label"))
    first = Window.partitionBy(*series).orderBy(F.desc("_n"), F.desc("_is_default"), "_seen")
    return units.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select(*series, "unit_key", "unit_label")


def conversion_factors(conversions: DataFrame, units: DataFrame, *, test: str = "test_type") -> DataFrame:
    """``test, from_key, to_key, factor``: every active conversion by each spelling of its units; the first wins."""
    spellings = units.select("name", F.explode(F.array_distinct(F.transform(F.array("symbol", "name"), normalize_unit))).alias("key"))
    a, b = spellings.toDF("from_unit", "from_key"), spellings.toDF("to_unit", "to_key")
    rows = conversions.where("is_active").join(F.broadcast(a), "from_unit").join(F.broadcast(b), "to_unit")
    return rows.groupBy(test, "from_key", "to_key").agg(F.min_by("conversion_factor", F.struct("from_unit", "to_unit")).alias("factor"))


def trend_points(results: DataFrame, factors: DataFrame, *, series: list[str], test: str, unit: str, value: str, printed_range: str, order: list[str], default: Column | None = None) -> DataFrame:
    """``results`` in their series' dominant unit: ``trend_unit, trend_value, trend_range, unit_status``.

    ``unit_status`` is ``same`` for that unit and for a blank one, ``converted``, or ``unconverted``, where value and
    range stay as printed.
    """
    target = dominant_unit(results, series=series, unit=unit, order=order, default=default).withColumnRenamed("unit_key", "_target")
    # Rows are dealt out by their series alone: there are few units, so that a join by these would send most rows to one task.
    keyed = results.withColumn("_key", normalize_unit(unit)).join(target, series, "left")
    f = small(factors.select(F.col(test).alias("_test"), F.col("from_key").alias("_from"), F.col("to_key").alias("_to"), "factor"), 100_000, 8_000_000)
    told = keyed.join(f, (F.col(test) == F.col("_test")) & (F.col("_key") == F.col("_from")) & (F.col("_target") == F.col("_to")), "left")
    same = (F.col("_key") == "") | F.col("_target").isNull() | (F.col("_key") == F.col("_target"))
    # A column of its own, so that values are converted once.
    told = told.withColumn("_converted", F.when(~same & F.col("factor").isNotNull(), convert_value(value, F.col("factor"))))
    told = told.withColumn("unit_status", F.when(same, "same").when(F.col("_converted").isNotNull(), "converted").otherwise("unconverted"))
    is_converted = F.col("unit_status") == "converted"
    return told.select(
        *results.columns,
        F.when(F.col("unit_status") == "unconverted", F.col(unit)).otherwise(F.coalesce("unit_label", F.lit(""))).alias("trend_unit"),
        F.coalesce("_converted", value).alias("trend_value"),
        F.when(is_converted, convert_range(printed_range, F.col("factor"))).otherwise(F.col(printed_range)).alias("trend_range"),
        "unit_status",
    )


def half_split(points: DataFrame, *, series: list[str], order: list[str], value: str, steady: float = 5.0, higher_is_better: str | None = None) -> DataFrame:
    """Mean of the second half against the first, in percent, and its class; the odd point belongs to the second half.

    Below ``steady`` percent either way it is ``STABLE``, else ``IMPROVING`` or ``DETERIORATING``: falling is better, unless
    the series' first row says in ``higher_is_better`` that rising is. Points that aren't numbers don't count. Fewer than
    two points, or a first mean of 0, are no change.
    """
    better = F.coalesce(F.col(higher_is_better), F.lit(False)) if higher_is_better else F.lit(False)
    rows = points.select(*series, F.col(value).cast("string").try_cast("double").alias("_v"), better.alias("_better"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    by, placed = Window.partitionBy(*series), [f"_o{i}" for i in range(len(order))]
    rows = rows.withColumn("_better", F.first("_better").over(by.orderBy(*placed))).where("_v IS NOT NULL AND NOT isnan(_v)")
    rows = rows.withColumn("_at", F.row_number().over(by.orderBy(*placed))).withColumn("_n", F.count("*").over(by))
    early = F.col("_at") <= F.floor(F.col("_n") / 2)
    means = rows.groupBy(*series).agg(F.count("*").alias("n"), F.avg(F.when(early, F.col("_v"))).alias("first_mean"), F.avg(F.when(~early, F.col("_v"))).alias("second_mean"), F.bool_or("_better").alias("_better"))
    change = F.when((F.col("n") < 2) | (F.col("first_mean") == 0), F.lit(0.0)).otherwise((F.col("second_mean") - F.col("first_mean")) / F.col("first_mean") * 100)
    kind = F.when(F.abs(change) < steady, "STABLE").when((change > 0) == F.col("_better"), "IMPROVING").otherwise("DETERIORATING")
    return means.select(*series, "n", "first_mean", "second_mean", change.alias("change_pct"), kind.alias("trend"))


def neighbours(rows: DataFrame, *, partition: list[str], order: list[Column], id: str) -> DataFrame:  # noqa: A002
    """``rows`` with the ids before and after, the position from 1, and the number of rows of the partition."""
    by = Window.partitionBy(*partition)
    ordered = by.orderBy(*order)
    return rows.select("*", F.lag(id).over(ordered).alias("previous_id"), F.lead(id).over(ordered).alias("next_id"), F.row_number().over(ordered).cast("long").alias("position"), F.count("*").over(by).alias("total"))


def aligned_table(points: DataFrame, *, keys: list[str], date: str, series: str, value: str, names: list[str], order: list[str]) -> DataFrame:
    """One column for each of ``names``; readings of one day and series follow each other in rows of their own."""
    at = F.row_number().over(Window.partitionBy(*keys, date, series).orderBy(*order)).cast("long")
    return points.withColumn("reading", at).groupBy(*keys, date, "reading").pivot(series, names).agg(F.max(value))


def series_span(points: DataFrame, *, series: list[str], value: str, pad: float = 0.1) -> DataFrame:
    number = comparable_number(F.col(value).cast("string"))
    spans = points.groupBy(*series).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    margin = (F.col("high") - F.col("low")) * pad
    return spans.select(*series, "low", "high", (F.col("low") - margin).alias("axis_low"), (F.col("high") + margin).alias("axis_high"))

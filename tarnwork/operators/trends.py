"""Trends that tenants ask for by a test, a printed name or a typed search, several at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import normalize_identifier
from tarnwork.operators.resolve import alias_key, resolve_names
from tarnwork.operators.series import trend_points
from tarnwork.session import materialize

#: What a trend is asked for by, in the order in which trends are given.
KINDS = ("test_type", "name", "parameter")


def unlinked_key(name: Column | str) -> Column:
    """The key that spellings of a name without a test share."""
    return F.coalesce(alias_key(name), normalize_identifier(name))


def asked_series(asked: DataFrame, catalog: DataFrame, *, tenant: str, links: DataFrame | None = None, most: int = 10) -> DataFrame:
    """``tenant, trend_key, at, kind, trend_name, trend_test, trend_default, matches, problem`` from ``asked(tenant, at, kind, value)``.

    A test's name stands for its results, a printed name for results without a test, and a typed search for those of the
    test it is read as and those without a test of that very name. Blank and unknown kinds are left out. What leads to
    one key is one series, that of the first kind and then the smallest ``at``. Tenants who ask for more than ``most``
    get no series but one row with a ``problem``.
    """
    kind_at = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = asked.select(tenant, "at", "kind", F.trim("value").alias("value"), kind_at.alias("_kind_at")).where("value <> '' AND _kind_at > 0")
    rows = rows.join(rows.groupBy(tenant).agg(F.count("*").alias("_asked")), tenant)
    refused = rows.where(F.col("_asked") > most).groupBy(tenant).agg(F.min("at").alias("at"))
    typed = rows.where(F.col("_asked") <= most).withColumn("_typed", F.when(F.col("kind") == "parameter", F.col("value")))
    read = resolve_names(typed, catalog, key=[tenant, "at"], printed="_typed", links=links, tenant=tenant)
    known = catalog.select(F.col("name").alias("_name"), F.col("display_name").alias("_shown"), F.col("default_unit").alias("trend_default"))
    told = read.withColumn("test", F.when(F.col("kind") == "test_type", F.col("value")).otherwise(F.col("test"))).join(known, F.col("test") == F.col("_name"), "left")
    by_test = F.when(F.col("_name").isNotNull(), F.concat(F.lit("type:"), "_name"))
    key = F.concat(F.lit("name:"), unlinked_key("value"))
    matches = F.when(F.col("kind") == "test_type", F.array(by_test)).when(F.col("kind") == "name", F.array(key)).otherwise(F.array(by_test, F.concat(F.lit("text:"), F.upper("value"))))
    told = told.withColumn("trend_key", F.when(F.col("test").isNotNull(), F.concat(F.lit("type:"), "test")).otherwise(key)).withColumn("matches", F.array_compact(matches))
    shown = F.coalesce("_shown", "value").alias("trend_name")
    series = told.groupBy(tenant, "trend_key").agg(F.min_by(F.struct("at", "kind", shown, F.col("_name").alias("trend_test"), "trend_default", "matches"), F.struct("_kind_at", "at")).alias("s"))
    series = series.select(tenant, "trend_key", "s.*", F.lit(None).cast("string").alias("problem"))
    return series.unionByName(refused.select(tenant, "at", F.lit(f"more than {most} trends").alias("problem")), allowMissingColumns=True)


def several_trends(results: DataFrame, asked: DataFrame, factors: DataFrame, *, tenant: str, test: str, name: str, unit: str, value: str, printed_range: str, order: list[str]) -> DataFrame:
    """The points of all series of ``asked_series``: ``results`` with the series' columns and those of ``trend_points``.

    Results are read once and joined by tenant and what they may be asked by; each is converted by the ``factors`` of
    the series' test, as ``conversion_factors`` gives them.
    """
    wanted = asked.where("problem IS NULL").select(F.col(tenant).alias("_tenant"), "trend_key", "trend_name", "trend_test", "trend_default", F.explode("matches").alias("_wanted"))
    bare = lambda token: F.when(F.col(test).isNull(), token)
    # Three places in any case: Spark then adds no condition of its own that makes the keys once more.
    tokens = F.array(F.concat(F.lit("type:"), F.col(test)), bare(F.concat(F.lit("text:"), F.upper(name))), bare(F.concat(F.lit("name:"), unlinked_key(name))))
    found = results.withColumn("_match", F.explode(tokens)).join(wanted, (F.col(tenant) == F.col("_tenant")) & (F.col("_match") == F.col("_wanted"))).drop("_match", "_tenant", "_wanted")
    # Written once: both the series' units and their points are made of what is asked for.
    found = materialize(found, "trend-results")
    return trend_points(found, factors.withColumnRenamed("test_type", "trend_test"), series=[tenant, "trend_key"], test="trend_test", unit=unit, value=value, printed_range=printed_range, order=order, default=F.col("trend_default"))


def trend_heads(points: DataFrame, asked: DataFrame, *, tenant: str) -> DataFrame:
    """Each series, those without points too, with its ``unit``, number of ``points`` and ``unconverted`` ones."""
    told = points.groupBy(tenant, "trend_key").agg(F.max(F.when(F.col("unit_status") != "unconverted", F.col("trend_unit"))).alias("unit"), F.count("*").alias("points"), F.count_if(F.col("unit_status") == "unconverted").alias("unconverted"))
    heads = asked.join(told, [tenant, "trend_key"], "left")
    return heads.select(*asked.columns, F.coalesce("unit", F.lit("")).alias("unit"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("points", "unconverted")])

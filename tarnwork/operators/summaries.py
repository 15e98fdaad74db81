"""Groups, counts, search, and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import contains_plain


def parameter_summary(results: DataFrame, *, tenant: list[str], test: str, display: str, printed: str, value: str, name_key: Column) -> DataFrame:
    """Results by catalog test, or by name where there is none: counts, printed names in order, and the name to show."""
    key = F.coalesce(F.concat(F.lit("type:"), F.col(test)), F.concat(F.lit("name:"), name_key))
    groups = results.groupBy(*tenant, key.alias("parameter")).agg(
        F.count("*").alias("result_count"),
        F.count(F.col(value).try_cast("double")).alias("numeric_count"),
        F.sort_array(F.collect_set(printed)).alias("printed_names"),
        F.max(display).alias("_display"),
    )
    return groups.select(*tenant, "parameter", "result_count", "numeric_count", "printed_names", F.coalesce("_display", F.get("printed_names", F.lit(0))).alias("name"))


def child_counts(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], *, key: str) -> DataFrame:
    """Parents with a count of each kind of child, zero included; children are counted before the join."""
    for name, (rows, parent) in children.items():
        parents = parents.join(rows.groupBy(F.col(parent).alias(key)).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parents


def search(rows: DataFrame, query: str, columns: list[str], *, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with the query in any column; ``truncated`` says whether there are more."""
    match = F.lit(False)
    for c in columns:
        match = match | F.coalesce(contains_plain(c, query), F.lit(False))
    found = rows.where(match).orderBy(*order).limit(limit + 1)
    ranked = found.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(0))) > limit)
    return ranked.where(F.col("_at") <= limit).drop("_at")


def page(rows: DataFrame, *, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def commonest(rows: DataFrame, *, keys: list[str], of: str, most: int) -> DataFrame:
    """The commonest values of each group, ties in their own order."""
    counted = rows.groupBy(*keys, of).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), of))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def last_per_group(rows: DataFrame, *, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The last ``most`` rows of each group; give ``order`` from the last on."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def change_histogram(changes: DataFrame, columns: list[str]) -> DataFrame:
    return changes.groupBy(*columns).agg(F.count("*").alias("n"))


def bucket_counts(rows: DataFrame, *, keys: list[str], status: str, buckets: dict[str, list[str]]) -> DataFrame:
    """All rows, and those in each bucket of statuses, by group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("all"), *[F.count_if(F.col(status).isin(*values)).alias(name) for name, values in buckets.items()])


def shared_range(rows: DataFrame, *, series: list[str], printed: str) -> DataFrame:
    """The only range that a series' results print, else null; blanks don't count."""
    text = F.nullif(F.trim(F.col(printed)), F.lit(""))
    return rows.groupBy(*series).agg(F.min(text).alias("_low"), F.max(text).alias("_high")).select(*series, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("shared_range"))

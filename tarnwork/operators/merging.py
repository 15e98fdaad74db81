"""Merging tables: first occurrences, precedence, upserts, protected rows, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_occurrence(rows: DataFrame, *, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def merge_sources(sources: list[DataFrame], *, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of all sources; of equal keys the earlier source's first row stays. ``source`` is its number."""
    both = None
    for i, rows in enumerate(sources):
        rows = rows.withColumn("source", F.lit(i))
        both = rows if both is None else both.unionByName(rows)
    return first_occurrence(both, keys=list(keys), order=["source", *order])


def larger_source(sources: list[DataFrame], *, keys: list[str]) -> DataFrame:
    """By group, all rows of the source with most of them; the earlier one wins a tie."""
    both = None
    for i, rows in enumerate(sources):
        rows = rows.withColumn("source", F.lit(i))
        both = rows if both is None else both.unionByName(rows)
    best = both.groupBy(*keys, "source").count().groupBy(*keys).agg(F.max_by("source", F.struct("count", -F.col("source"))).alias("source"))
    return both.join(best, [*keys, "source"], "left_semi")


def replace_or_supplement(base: DataFrame, extra: DataFrame, *, keys: list[str], group: list[str], reader: str = "reader", order: list[str] | None = None) -> DataFrame:
    """Plug-in rows ``extra(…, mode, priority)`` over ``base``.

    Of replacing readers of one priority the first by name counts, where ``extra`` has a column ``reader``. Rows of one
    supplement follow each other by ``order``; base and replacing rows all stay.

    Of the replacing ones only those of the highest priority count, and they take the place of the group's base rows;
    supplementing ones are added unless their keys are there already, higher priorities first.
    """
    highest = Window.partitionBy(*group, "mode")
    name = F.col(reader) if reader in extra.columns else F.lit(0)
    ranked = extra.withColumn("_top", F.min(F.struct(-F.col("priority"), name)).over(highest))
    replacing = ranked.where((F.col("mode") == "replace") & (F.struct(-F.col("priority"), name) == F.col("_top"))).drop("_top", "mode")
    kept = base.join(replacing.select(*group).distinct(), group, "left_anti").withColumn("priority", F.lit(None).cast("int"))
    main = kept.unionByName(replacing.select(*kept.columns))
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"_there_{k}"))
        same = equal if same is None else same & equal
    there = main.select(*[F.col(k).alias(f"_there_{k}") for k in keys]).distinct()
    added = ranked.where("mode = 'supplement'").select(*kept.columns).join(there, same, "left_anti")
    return main.unionByName(first_occurrence(added, keys=keys, order=[F.desc_nulls_last("priority"), *([reader] if reader in kept.columns else []), *(order or [])]))


def upsert(current: DataFrame, new: DataFrame, *, keys: list[str], protected: str | None = None, order: list[str] | None = None) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those of equal keys; rows whose ``protected`` holds stay.

    Of new rows of one key the last by ``order`` counts (without it, the one of greatest columns).
    """
    last = [F.col(c).desc_nulls_last() for c in (order or [c for c, kind in new.dtypes if not kind.startswith("map")])]
    new = first_occurrence(new, keys=list(keys), order=last)
    if protected:
        new = new.join(current.where(F.coalesce(protected, F.lit(False))).select(*keys), keys, "left_anti")
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def remove_rows(current: DataFrame, gone: DataFrame, *, keys: list[str], source: str = "source") -> DataFrame:
    """Rows of users go; built-in ones become inactive."""
    marked = current.join(gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), keys, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    return marked.where(~(F.col("_gone") & (F.col(source) == "user"))).withColumn("is_active", F.col("is_active") & ~F.col("_gone")).drop("_gone")


def earliest_duplicate(rows: DataFrame, *, tenant: list[str], content: Column, order: list[str], id: str) -> DataFrame:  # noqa: A002
    """``rows`` with ``duplicate_of``: the earliest row of equal content of the tenant, null for itself."""
    first = F.first(id).over(Window.partitionBy(*tenant, content).orderBy(*order))
    return rows.withColumn("duplicate_of", F.when(first != F.col(id), first))


def unique_match(left: DataFrame, right: DataFrame, *, id: str, keys: list[str]) -> DataFrame:  # noqa: A002
    """``left`` with the id of its row in ``right``: by id, else by keys if these are unique on both sides."""
    both = lambda rows: rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    by_id = right.select(F.col(id).alias("_by_id"))
    by_key = both(right).where("_n = 1").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(id).alias("_by_key"))
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"_{k}")) if same is None else same & (F.col(k) == F.col(f"_{k}"))
    told = both(left).join(by_id, F.col(id) == F.col("_by_id"), "left").join(by_key, same & (F.col("_n") == 1), "left")
    return told.select(*left.columns, F.coalesce("_by_id", "_by_key").alias("matched_id"))

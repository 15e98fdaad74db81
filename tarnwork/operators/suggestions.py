"""Suggested changes of rows: check, apply, undo, dismiss. The current table is the fold of a log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import is_printed, same_text

ACTIONS = ("add", "update", "remove")


def clean_suggestions(raw: DataFrame, rows: DataFrame, *, text: str, most: int = 100) -> DataFrame:
    """``raw(report_id, suggestion_id, action, row_id, value, {text})`` without what isn't valid, changes nothing or isn't printed.

    ``rows`` has ``row_id, value``. At most ``most`` stay by report, the first ones.
    """
    known = rows.select(F.col("row_id").alias("_row"), F.col("value").alias("old_value"))
    told = raw.where(F.col("action").isin(*ACTIONS)).join(known, F.col("row_id") == F.col("_row"), "left")
    on_row = (F.col("action") == "add") | F.col("_row").isNotNull()
    changes = (F.col("action") != "update") | ~same_text("value", "old_value")
    printed = (F.col("action") == "remove") | F.coalesce(is_printed("value", text), F.lit(False))
    kept = told.where(on_row & changes & printed).drop("_row", text)
    return kept.withColumn("_at", F.row_number().over(Window.partitionBy("report_id").orderBy("suggestion_id"))).where(F.col("_at") <= most).drop("_at")


def suggestion_key(*columns: str):
    """What makes suggestions the same."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def without_dismissed(suggestions: DataFrame, dismissed: DataFrame, *, keys: list[str]) -> DataFrame:
    return suggestions.join(dismissed.select(*keys).distinct(), keys, "left_anti")


def still_open(suggestions: DataFrame, rows: DataFrame) -> DataFrame:
    """Without suggestions that are fulfilled already, or whose row is gone."""
    known = rows.select(F.col("row_id").alias("_row"), F.col("value").alias("_now"))
    told = suggestions.join(known, F.col("row_id") == F.col("_row"), "left")
    return told.where((F.col("action") == "add") | (F.col("_row").isNotNull() & ((F.col("action") == "remove") | ~same_text("value", "_now")))).drop("_row", "_now")


def change_log(suggestions: DataFrame, rows: DataFrame) -> DataFrame:
    """``change_id, row_id, action, before, after`` of suggestions as they are applied."""
    known = rows.select(F.col("row_id").alias("_row"), F.col("value").alias("before"))
    told = suggestions.join(known, F.col("row_id") == F.col("_row"), "left")
    return told.select(F.col("suggestion_id").alias("change_id"), "row_id", "action", "before", F.when(F.col("action") != "remove", F.col("value")).alias("after"))


def apply_changes(rows: DataFrame, log: DataFrame) -> DataFrame:
    """``rows(row_id, value)`` after the log: the last change of each row counts; one without an after removes it.

    Rows without a value that no change touches stay.
    """
    last = log.groupBy("row_id").agg(F.max_by(F.struct("after"), "change_id").alias("_last"))
    folded = rows.join(last, "row_id", "full").where(F.col("_last").isNull() | F.col("_last.after").isNotNull())
    return folded.select("row_id", F.when(F.col("_last").isNull(), F.col("value")).otherwise(F.col("_last.after")).alias("value"))


def undo_changes(rows: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the log's changes taken back, and the changes that can't be, as their rows have changed since."""
    now = rows.select(F.col("row_id").alias("_row"), F.col("value").alias("_now"))
    told = log.join(now, F.col("row_id") == F.col("_row"), "left").withColumn("_fits", F.col("_now").eqNullSafe(F.col("after")))
    back = told.where("_fits").select("change_id", "row_id", F.col("before").alias("after"))
    return apply_changes(rows, back), told.where("NOT _fits").select("change_id", "row_id")


def queue_jobs(asked: DataFrame, reports: DataFrame) -> DataFrame:
    """``report_id, queued, reason`` for distinct ids asked for; only finished reports can be queued."""
    told = asked.select("report_id").distinct().join(reports.select("report_id", "status"), "report_id", "left")
    reason = F.when(F.col("status").isNull(), "not found").when(F.col("status") != "COMPLETED", "not ready")
    return told.select("report_id", reason.isNull().alias("queued"), reason.alias("reason"))


def relink(rows: DataFrame, resolved: DataFrame, *, id: str) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """Rows whose test changes with ``resolved(id, test)``, and how often each change occurs."""
    told = rows.join(resolved.select(id, F.col("test").alias("new_test")), id, "left")
    changed = told.where(~F.col("test").eqNullSafe(F.col("new_test")))
    return changed, changed.groupBy("test", "new_test").agg(F.count("*").alias("n"))

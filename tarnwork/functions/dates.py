"""Dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwork.functions.text import col

#: Days, not calendar months.
PERIOD_DAYS = {"3m": 91, "6m": 182, "1y": 365, "2y": 730}


def period_start(today: Column, period: str) -> Column:
    """The first day of a period, which it includes; null for ``all``."""
    return F.lit(None).cast("date") if period == "all" else F.date_sub(today, PERIOD_DAYS[period])


def age(born: Column | str, today: Column) -> Column:
    """Completed years."""
    born = col(born)
    early = (F.month(today) * 100 + F.dayofmonth(today)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(today) - F.year(born) - early.cast("int")


def local_day(moment: Column | str, zone: Column | str) -> Column:
    """The day of an instant where ``zone``, a column of names of time zones, is in use; that of the session doesn't matter."""
    return F.convert_timezone(None, col(zone), col(moment).cast("timestamp")).cast("date")


def flexible_date(text: Column | str) -> Column:
    """ISO, day first, else month first, or with a month's name; a time after it doesn't count."""
    plain = F.regexp_replace(F.trim(col(text)), r"(?i)[T\s]+\d{1,2}:\d{2}.*$", "")
    slashed = F.regexp_replace(plain, r"[.\-/\s,]+", "/")
    formats = ["yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d/MMM/yyyy", "MMM/d/yyyy", "d/MMMM/yyyy", "MMMM/d/yyyy"]
    return F.coalesce(*[F.try_to_date(slashed, f) for f in formats])


def date_time_text(text: Column | str) -> Column:
    """``yyyy-MM-dd``, with `` HH:mm`` where a time of 12 or 24 hours follows; null if date or time isn't real."""
    plain = F.regexp_replace(F.trim(col(text)), r"\s+", " ")
    pattern = r"(?i)[ T](\d{1,2}):(\d{2})(?::\d{2}(?:\.\d+)?)?\s*(am|pm)?$"
    part = lambda group: F.regexp_extract(plain, pattern, group)
    day, hours, minutes, half = F.date_format(flexible_date(plain), "yyyy-MM-dd"), part(1).try_cast("int"), part(2).try_cast("int"), F.lower(part(3))
    of_day = F.when(half == "", F.when(hours <= 23, hours)).when(hours.between(1, 12), hours % 12 + F.when(half == "pm", 12).otherwise(0))
    time = F.when(minutes <= 59, F.concat(F.lit(" "), F.lpad(of_day.cast("string"), 2, "0"), F.lit(":"), part(2)))
    return F.concat(day, F.when(hours.isNull(), "").otherwise(time))


def file_name_parts(name: Column | str) -> Column:
    """``struct<day, lab, ok>`` of ``YYYY-MM-DD[_lab|-x].pdf``."""
    pattern = r"(?i)^(\d{4}-\d{2}-\d{2})(?:_([^/]*?)|-[^/]*)?\.pdf$"
    day = F.try_to_date(F.regexp_extract(col(name), pattern, 1), "yyyy-MM-dd")
    return F.struct(day.alias("day"), F.nullif(F.regexp_extract(col(name), pattern, 2), F.lit("")).alias("lab"), day.isNotNull().alias("ok"))

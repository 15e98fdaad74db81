"""Lines that name a common test by a keyword: the simplest reader, for text without any layout."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.status import range_status
from tarnwork.functions.text import col, once, trimmed

#: Tests and what names them anywhere in a line, in any case; the first test that is named counts.
KEYWORDS = {
    "blood_glucose": "glucose|sugar|fbs|rbs|hba1c",
    "creatinine": "creatinine|creat",
    "urea": "urea|bun",
    "cholesterol": "cholesterol|hdl|ldl|triglycerides",
    "hemoglobin": "hemoglobin|hb|hgb",
    "wbc": "wbc|white blood cell|leukocyte",
    "rbc": "rbc|red blood cell|erythrocyte",
    "platelet": "platelet|plt",
    "sodium": "sodium|na",
    "potassium": "potassium|k",
    "calcium": "calcium|ca",
    "phosphorus": "phosphorus|phosphate|po4",
    "alt": "alt|alanine aminotransferase|sgpt",
    "ast": "ast|aspartate aminotransferase|sgot",
    "alkaline_phosphatase": "alkaline phosphatase|alp",
    "bilirubin": "bilirubin|total bilirubin|direct bilirubin",
    "protein": "total protein|albumin|globulin",
    "tsh": "tsh|thyroid stimulating hormone",
    "t3": "t3|triiodothyronine",
    "t4": "t4|thyroxine",
    "vitamin_d": "vitamin d|25-oh vitamin d",
    "vitamin_b12": "vitamin b12|b12|cobalamin",
    "folate": "folate|folic acid",
    "iron": "iron|ferritin|transferrin",
}
#: The first number of a line with the letters after it, and what announces a range, the first that is there.
VALUE = r"(\d+\.?\d*)(?U:\s)*([a-zA-Z/%]+)?"
RANGE_WORDS = ("ref", "reference", "normal", "range")


def keyword_of(line: Column | str, keywords: dict[str, str] = KEYWORDS) -> Column:
    """The first test that the line names; null if there is none.

    Plain words are looked for as they are in lines of ASCII, where that finds what the patterns do.
    """
    line = col(line)
    by_pattern = F.coalesce(*[F.when(line.rlike(f"(?iu){words}"), name) for name, words in keywords.items()])
    if not all(re.fullmatch("[a-z0-9 |-]+", words) for words in keywords.values()):
        return by_pattern
    has = lambda low, words: reduce(or_, [F.contains(low, F.lit(w)) for w in words.split("|")])
    by_word = once(F.lower(line), lambda low: F.coalesce(*[F.when(has(low, words), name) for name, words in keywords.items()]))
    return F.when(F.octet_length(line) == F.length(line), by_word).otherwise(by_pattern)


def announced_range(line: Column | str) -> Column:
    """What follows the word for a range, up to a comma; empty without such a word. ``reference`` is read as ``ref`` and more text."""
    patterns = [rf"(?iu){word}[:\s\x85\p{{Z}}]*([^,\n]+)" for word in RANGE_WORDS]
    return F.coalesce(*[F.when(col(line).rlike(p), trimmed(F.regexp_extract(col(line), p, 1))) for p in patterns], F.lit(""))


def keyword_results(docs: DataFrame, *, id: str, text: str, keywords: dict[str, str] = KEYWORDS) -> DataFrame:  # noqa: A002
    """``id, line_no, test_name, value, unit, reference_range, status, raw_line``: one row for each line that names a test and holds a number.

    Lines are numbered from 0, blank ones too. Digits are 0 to 9. Null and empty texts give no rows; rows that repeat are
    read each. No row is shuffled.
    """
    lines = docs.select(F.col(id), F.posexplode(F.transform(F.split(F.col(text), "\n"), trimmed)).alias("line_no", "raw_line"))
    # A line without a digit has no value, so no keyword is looked for in it.
    named = lines.where(F.col("raw_line").rlike("[0-9]")).withColumn("test_name", keyword_of("raw_line", keywords)).where("test_name IS NOT NULL")
    read = named.select("*", *[F.regexp_extract("raw_line", VALUE, i).alias(name) for i, name in ((1, "value"), (2, "unit"))], announced_range("raw_line").alias("reference_range"))
    return read.select(id, "line_no", "test_name", "value", "unit", "reference_range", range_status("value", "reference_range").alias("status"), "raw_line")

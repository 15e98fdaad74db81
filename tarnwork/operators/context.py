"""Names by the context of their section, by the size of their values, and phases of streamed replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.numbers import comparable_number
from tarnwork.functions.status import PRINTED_RANGE, range_status
from tarnwork.operators.catalog import rules_by_printed_unit
from tarnwork.operators.resolve import resolve_names

#: The tests that names stand for in a section.
IN_CONTEXT = {
    "urine": {"creatinine": "urine_creatinine", "protein total": "urine_protein", "protein": "urine_protein"},
    "dlc": {
        "segmented neutrophils": "dlc_neutrophils", "neutrophils": "dlc_neutrophils", "lymphocytes": "dlc_lymphocytes",
        "monocytes": "dlc_monocytes", "eosinophils": "dlc_eosinophils", "basophils": "dlc_basophils",
    },
    "alc": {
        "segmented neutrophils": "alc_neutrophils", "neutrophils": "alc_neutrophils", "lymphocytes": "alc_lymphocytes",
        "monocytes": "alc_monocytes", "eosinophils": "alc_eosinophils", "basophils": "alc_basophils",
    },
}
#: Upper normal limits where no rule gives one, and the factors beyond which a value is the other test's.
SERUM_CEILING, URINE_CEILING = 1.5, 392.0
ABOVE_SERUM, RANGE_ABOVE_SERUM, BELOW_URINE = 5, 10, 20


def _known(rows: DataFrame, catalog: DataFrame, wanted: Column, *, test: str) -> DataFrame:
    """``rows`` with ``test`` replaced by ``wanted`` where the catalog has it."""
    names = catalog.select(F.col("name").alias("_wanted")).distinct()
    joined = rows.withColumn("_want", wanted).join(names, F.col("_want") == F.col("_wanted"), "left")
    return joined.withColumn(test, F.coalesce("_wanted", test)).select(*rows.columns)


def tests_in_context(rows: DataFrame, catalog: DataFrame, *, test: str, context: str) -> DataFrame:
    """``rows`` whose ``test`` is that of their section, if ``catalog(name)`` has it; a prefix of another section doesn't count.

    Without a section, or for a name that it doesn't change, ``test`` stays, null too.
    """
    entries = [(f"{section}:{name}", mapped) for section, names in IN_CONTEXT.items() for name, mapped in names.items()]
    table = F.create_map(*[F.lit(x) for entry in entries for x in entry])
    mapped = lambda name: F.try_element_at(table, F.concat(F.col(context), F.lit(":"), name))
    base = F.regexp_replace(test, "^(?:dlc|alc|urine)_", "")
    return _known(rows, catalog, F.coalesce(mapped(F.col(test)), mapped(base)), test=test)


def serum_or_urine(rows: DataFrame, catalog: DataFrame, rules: DataFrame, *, test: str, value: str, printed: str) -> DataFrame:
    """``rows`` whose creatinine is that of serum or of urine by its value, or by the upper end of its printed range.

    ``rules(name, normal_max)`` has at most one row for a name; a limit that is null or 0 doesn't count.
    """
    limits = rules.select(F.col("name").alias("_name"), F.nullif(F.col("normal_max").cast("double"), F.lit(0.0)).alias("_max"))
    v = comparable_number(value)
    upper = F.nullif(F.regexp_extract(F.coalesce(printed, F.lit("")), PRINTED_RANGE, 2), F.lit("")).try_cast("double")
    serum, urine = F.coalesce("_max", F.lit(SERUM_CEILING)), F.coalesce("_max", F.lit(URINE_CEILING))
    is_urine = (v > serum * ABOVE_SERUM) | (v.isNotNull() & (upper > serum * RANGE_ABOVE_SERUM))
    wanted = F.when((F.col(test) == "creatinine") & is_urine, "urine_creatinine").when((F.col(test) == "urine_creatinine") & (v < urine / BELOW_URINE), "creatinine")
    joined = rows.join(limits, F.col(test) == F.col("_name"), "left")
    return _known(joined, catalog, wanted, test=test).select(*rows.columns)


def section_of_name(name: Column) -> Column:
    """The section that a printed name tells by itself, or null."""
    n = F.lower(name)
    has = lambda part: F.contains(n, F.lit(part))
    return F.when(has("dlc)") | n.endswith(" %"), "dlc").when(has("alc)") | has("absolute"), "alc").when(n.startswith("urine ") | has(" urine"), "urine")


def normalized_rows(rows: DataFrame, catalog: DataFrame, rules: DataFrame, defaults: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows(row_id, name, value, unit, printed, status, section)`` under the catalog's names, where it has them.

    Rows without a name, or with a person's title in it, go. ``section`` follows from the name where it isn't given. A
    number with a printed range gets its status from that, else from ``rules`` by ``defaults(test, unit)``; other rows keep
    theirs. ``limits(name, normal_max)`` are those of ``serum_or_urine``. ``raw_name`` is the name as printed, ``display_name``
    the catalog's or that; a null value or unit stays.
    """
    raw = F.trim(F.coalesce("name", F.lit("")))
    kept = rows.withColumn("raw_name", raw).where((raw != "") & ~raw.rlike(r"(?i)\b(?:mr|mrs|ms|miss)\.\s*[a-z]"))
    kept = kept.withColumn("_within", F.coalesce(F.nullif("section", F.lit("")), section_of_name(F.col("raw_name"))))
    bare = F.regexp_replace("raw_name", r"(?i)\s*\((?:dlc|alc)\)\s*$", "")
    asked = kept.withColumn("_lookup", F.trim(F.regexp_replace(bare, r"(?i)^urine\s+", "")))
    found = resolve_names(asked, catalog, key=["row_id"], printed="_lookup", context="_within", unit="unit", value="value").drop("_lookup")
    found = serum_or_urine(tests_in_context(found, catalog, test="test", context="_within"), catalog, limits, test="test", value="value", printed="printed")
    ruled = rules_by_printed_unit(found.withColumnRenamed("status", "_before"), rules, defaults).withColumnRenamed("status", "_by_rule")
    number = comparable_number("value").isNotNull() & (F.coalesce("printed", F.lit("")) != "")
    by_range = F.nullif(range_status("value", "printed"), F.lit("UNKNOWN"))
    status = F.when(number, F.coalesce(by_range, F.when(F.col("test").isNotNull(), F.col("_by_rule")), F.col("_before"))).otherwise(F.col("_before"))
    shown = catalog.select(F.col("name").alias("_name"), F.col("display_name").alias("_shown"))
    told = ruled.withColumn("status", status).join(shown, F.col("test") == F.col("_name"), "left")
    named = {"name": F.coalesce("test", "raw_name").alias("name"), "section": F.coalesce("_within", "section").alias("section")}
    return told.select(*[named.get(c, F.col(c)) for c in rows.columns], "raw_name", F.coalesce("_shown", "raw_name").alias("display_name"))


def reply_phases(chunks: DataFrame, *, reply: list[str], order: list[str], content: str, reasoning: str) -> DataFrame:
    """``chunks`` that say something, with ``reasoning_tokens, reply_tokens`` so far and ``phase`` (thinking or writing).

    A chunk counts as one token. Content is reasoning too, as long as a reply that begins with ``<think>`` hasn't closed
    it; the closing tag may be split over two chunks, and the chunk that closes it is the last of them. Chunks without
    content and reasoning (null or empty) go.
    """
    before = Window.partitionBy(*reply).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*reply).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.nullif(F.col(content), F.lit(""))
    rows = chunks.withColumn("_part", part)
    previous = F.coalesce(F.last("_part", ignorenulls=True).over(before), F.lit(""))
    begins = F.ltrim(F.first("_part", ignorenulls=True).over(so_far), F.lit(" \t\n\x0b\x0c\r")).startswith("<think>")
    rows = rows.select("*", begins.alias("_inline"), F.contains(F.concat(previous, F.col("_part")), F.lit("</think>")).alias("_closes"))
    open_ = F.coalesce(F.col("_inline"), F.lit(False)) & ~F.coalesce(F.max("_closes").over(before), F.lit(False))
    has = F.col("_part").isNotNull()
    thinks = F.when(has, open_).otherwise(F.nullif(F.col(reasoning), F.lit("")).isNotNull())
    rows = rows.select(*chunks.columns, thinks.alias("_thinks"), (has & ~open_).alias("_replies")).where("_thinks OR _replies")
    count = lambda flag: F.sum(F.col(flag).cast("long")).over(so_far)
    counted = rows.select(*chunks.columns, count("_thinks").alias("reasoning_tokens"), count("_replies").alias("reply_tokens"))
    return counted.withColumn("phase", F.when(F.col("reply_tokens") > 0, "writing").otherwise("thinking"))

"""A catalog of tests: units, conversions and rules looked up for printed results, and changes of the catalog itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.numbers import exact_product
from tarnwork.functions.status import rule_status, stored_status
from tarnwork.functions.text import normalize_identifier, suggest_key
from tarnwork.functions.units import normalize_unit
from tarnwork.session import small

#: So many rows of a catalog at most are sent to each task, with so many bytes as JSON. Rows of few tests and units are then not dealt out by these.
SMALL, SMALL_BYTES = 100_000, 8_000_000
BOUNDS = ("min_value", "max_value", "normal_min", "normal_max", "critical_low_min", "critical_high_max")


def unit_names(rows: DataFrame, units: DataFrame, *, unit: str, to: str = "unit_name") -> DataFrame:
    """``rows`` with the name of the unit in ``units(name, symbol)`` that is called so, else of the first with that symbol; else null."""
    by_name = small(units.select(F.col("name").alias("_name")).distinct(), SMALL, SMALL_BYTES)
    by_symbol = small(units.groupBy(F.col("symbol").alias("_symbol")).agg(F.min("name").alias("_of_symbol")), SMALL, SMALL_BYTES)
    told = rows.join(by_name, F.col(unit) == F.col("_name"), "left").join(by_symbol, F.col(unit) == F.col("_symbol"), "left")
    return told.select(*rows.columns, F.coalesce("_name", "_of_symbol").alias(to))


def rules_for(rows: DataFrame, rules: DataFrame, type_units: DataFrame, *, test: str = "test", unit: str = "unit") -> DataFrame:
    """``rows`` with ``rule``, the bounds of the active rule of test and unit, else the normal range of the test's active unit, and ``rule_source``.

    ``rules(test, unit, is_active, …)`` has any of ``BOUNDS``. Without either, ``rule_source`` is null.
    """
    bounds = lambda frame: F.struct(*[(F.col(b) if b in frame.columns else F.lit(None)).cast("decimal(18,4)").alias(b) for b in BOUNDS])
    one = lambda frame: frame.where("is_active").groupBy(F.col("test").alias("_test"), F.col("unit").alias("_unit")).agg(F.min(bounds(frame)).alias("_rule"))
    own, other = small(one(rules), SMALL, SMALL_BYTES), small(one(type_units).toDF("_test2", "_unit2", "_rule2"), SMALL, SMALL_BYTES)
    told = rows.join(own, (F.col(test) == F.col("_test")) & (F.col(unit) == F.col("_unit")), "left")
    told = told.join(other, (F.col(test) == F.col("_test2")) & (F.col(unit) == F.col("_unit2")), "left")
    source = F.when(F.col("_rule").isNotNull(), "rule").when(F.col("_rule2").isNotNull(), "unit")
    return told.select(*rows.columns, F.coalesce("_rule", "_rule2").alias("rule"), source.alias("rule_source"))


def rules_by_printed_unit(rows: DataFrame, rules: DataFrame, defaults: DataFrame, *, units: DataFrame | None = None, test: str = "test", unit: str = "unit", value: str = "value") -> DataFrame:
    """``rows`` with ``status`` by the test's rule for the printed unit, else for its default one; values that are no numbers are ``UNKNOWN``.

    A unit is printed as its rule's name or, by ``units(name, symbol)``, as its symbol, in any spelling; a blank one is
    none. A number with commas isn't one here. ``defaults`` has ``test, unit``, a row for each test.
    """
    own = small(defaults.select(F.col("test").alias("_of"), F.col("unit").alias("_default")), SMALL, SMALL_BYTES)
    told = rows.join(own, F.col(test) == F.col("_of"), "left").withColumn("_printed_unit", F.nullif(normalize_unit(unit), F.lit("")))
    spelled = rules.join(units.groupBy(F.col("name").alias("unit")).agg(F.min("symbol").alias("_symbol")), "unit", "left") if units is not None else rules.withColumn("_symbol", F.lit(None).cast("string"))
    spelled = spelled.withColumn("unit", F.explode(F.array_distinct(F.transform(F.array_compact(F.array("unit", "_symbol")), normalize_unit))))
    told = rules_for(told, spelled, spelled.where("false"), test=test, unit="_printed_unit").withColumnsRenamed({"rule": "_printed_rule"}).drop("rule_source")
    told = rules_for(told, rules, rules.where("false"), test=test, unit="_default")
    bounds = F.coalesce("_printed_rule", "rule")
    number = F.trim(value).try_cast("decimal(18,4)")
    status = F.when(bounds.isNull(), "UNKNOWN").otherwise(rule_status(number, {b: bounds[b] for b in BOUNDS}))
    return told.select(*rows.columns, status.alias("status"))


def validate_results(rows: DataFrame, rules: DataFrame, type_units: DataFrame, *, test: str = "test", unit: str = "unit", value: str = "value") -> DataFrame:
    """``rows`` with ``rule_source``, ``status`` and what is ``stored`` of it; all null where no rule is found."""
    told = rules_for(rows, rules, type_units, test=test, unit=unit)
    status = F.when(F.col("rule_source").isNotNull(), rule_status(F.col(value).cast("string").try_cast("decimal(18,4)"), {b: F.col(f"rule.{b}") for b in BOUNDS}))
    return told.select(*rows.columns, "rule_source", status.alias("status"), stored_status(status).alias("stored"))


def convert_results(rows: DataFrame, units: DataFrame, conversions: DataFrame, *, test: str = "test", unit: str = "unit", to: str = "to_unit", value: str = "value") -> DataFrame:
    """``rows`` with ``new_value, new_unit, problem``: the exact product, in the unit as it was asked for by ``to``.

    Both units are named or abbreviated. A value that can't be converted stays, with its unit and the reason: no unit to
    convert from (blank or ``N/A``), no such unit, no test, no active conversion, no plain number. ``conversions`` has ``test, from_unit, to_unit, conversion_factor, is_active`` by names of units.
    """
    told = unit_names(unit_names(rows, units, unit=unit, to="_from"), units, unit=to, to="_to")
    factors = conversions.where("is_active").groupBy(F.col("test").alias("_test"), F.col("from_unit").alias("_a"), F.col("to_unit").alias("_b")).agg(F.min("conversion_factor").alias("_factor"))
    factors = small(factors, SMALL, SMALL_BYTES)
    told = told.join(factors, (F.col(test) == F.col("_test")) & (F.col("_from") == F.col("_a")) & (F.col("_to") == F.col("_b")), "left")
    told = told.withColumn("_new", exact_product(value, F.col("_factor")))
    problem = (
        F.when(F.coalesce(unit, F.lit("")).isin("", "N/A"), "no unit").when(F.col("_from").isNull() | F.col("_to").isNull(), "unknown unit")
        .when(F.col(test).isNull(), "no test").when(F.col("_factor").isNull(), "no conversion").when(F.col("_new").isNull(), "no number")
    )
    return told.select(*rows.columns, F.when(problem.isNull(), F.col("_new")).otherwise(F.col(value)).alias("new_value"), F.when(problem.isNull(), F.col(to)).otherwise(F.col(unit)).alias("new_unit"), problem.alias("problem"))


def supported_units(type_units: DataFrame, units: DataFrame) -> DataFrame:
    """``test`` with each active unit's row of ``units``."""
    return type_units.where("is_active").select("test", F.col("unit").alias("name")).join(units, "name").select("test", *units.columns)


def conversions_among(conversions: DataFrame, type_units: DataFrame) -> DataFrame:
    """Active conversions both of whose units the test supports."""
    known = type_units.where("is_active").select("test", "unit")
    kept = conversions.where("is_active")
    for side in ("from_unit", "to_unit"):
        kept = kept.join(known.withColumnRenamed("unit", side).distinct(), ["test", side], "left_semi")
    return kept


def derived_ranges(conversions: DataFrame, defaults: DataFrame) -> DataFrame:
    """``test, unit, normal_min, normal_max, conversion_factor``: one row for each unit that a conversion leads to from the test's default one.

    ``defaults(test, unit, normal_min, normal_max)`` has a row for each test. The range is the default one times the
    factor from its unit, or, where only a conversion into it is known, times the reverse factor. Units that the test
    doesn't list yet are included: ``merging.upsert`` puts the rows among those it has.
    """
    base = defaults.select("test", F.col("unit").alias("_default"), "normal_min", "normal_max")
    rows = conversions.where("is_active").join(base, "test")
    leads_away = F.col("from_unit") == F.col("_default")
    rows = rows.where(leads_away | (F.col("to_unit") == F.col("_default")))
    rows = rows.withColumns({"unit": F.when(leads_away, F.col("to_unit")).otherwise(F.col("from_unit")), "_factor": F.when(leads_away, F.col("conversion_factor")).otherwise(F.col("reverse_factor")), "_back": ~leads_away})
    best = rows.groupBy("test", "unit").agg(F.min(F.struct("_back", "_factor", "normal_min", "normal_max")).alias("_r"))
    scaled = [F.bround(F.col(f"_r.{c}") * F.col("_r._factor"), 4).cast("decimal(18,4)").alias(c) for c in ("normal_min", "normal_max")]
    return best.select("test", "unit", *scaled, F.col("_r._factor").alias("conversion_factor"))


def deactivate_rules(rules: DataFrame, type_units: DataFrame) -> DataFrame:
    """``rules`` with those switched off whose unit the test no longer has."""
    known = type_units.where("is_active").select("test", "unit").distinct().withColumn("_known", F.lit(True))
    return rules.join(known, ["test", "unit"], "left").withColumn("is_active", F.col("is_active") & F.coalesce("_known", F.lit(False))).drop("_known").select(*rules.columns)


def backfill_tests(rows: DataFrame, catalog: DataFrame, *, name: str, test: str) -> DataFrame:
    """``rows`` with a missing ``test`` filled in from ``catalog(name, key)`` by name, whatever case and spaces; the smallest key wins."""
    keys = catalog.groupBy(normalize_identifier("name").alias("_name")).agg(F.min("key").alias("_key"))
    told = rows.join(keys, normalize_identifier(name) == F.col("_name"), "left")
    return told.select(*[F.coalesce(test, "_key").alias(test) if c == test else F.col(c) for c in rows.columns])


def both_directions(conversions: DataFrame) -> DataFrame:
    """Each of ``conversions(test, from_unit, to_unit, conversion_factor)`` and its reverse; given ones come before reversed ones."""
    reverse = conversions.select("test", F.col("to_unit").alias("from_unit"), F.col("from_unit").alias("to_unit"), (1 / F.col("conversion_factor")).cast("decimal(15,8)").alias("conversion_factor"))
    keys = ["test", "from_unit", "to_unit"]
    return conversions.select(*keys, F.col("conversion_factor").cast("decimal(15,8)").alias("conversion_factor")).unionByName(reverse.join(conversions.select(*keys), keys, "left_anti"))


def free_keys(new: DataFrame, existing: DataFrame, *, name: str, order: list[str], key: str = "key") -> DataFrame:
    """``new`` with a key of its own for each row: its name's slug if that is free, else with the smallest free number from 2 on.

    Rows of one slug are served by ``order``. Taken are the keys of ``existing`` and, as numbers, slugs of other new rows.
    A name without letters and digits gets no key.
    """
    slug = suggest_key(name)
    rows = new.withColumn("_slug", slug).withColumn("_nth", F.row_number().over(Window.partitionBy("_slug").orderBy(*order)))
    keys = existing.select(F.col(key).alias("_key")).unionByName(rows.where(F.col("_slug").rlike(r"_\d+$")).select(F.col("_slug").alias("_key"))).distinct()
    bare = existing.select(F.col(key).alias("_base"), F.lit(1).alias("_number"))
    numbered = keys.where(F.col("_key").rlike(r"_[1-9]\d{0,8}$")).select(F.regexp_replace("_key", r"_\d+$", "").alias("_base"), F.regexp_extract("_key", r"_(\d+)$", 1).cast("int").alias("_number")).where("_number >= 2")
    taken = bare.unionByName(numbered).distinct().withColumn("_at", F.row_number().over(Window.partitionBy("_base").orderBy("_number")))
    # So many free numbers lie below each taken one; the nth free one comes after all with less than n of them.
    gaps = taken.groupBy("_base").agg(F.array_sort(F.collect_list(F.col("_number") - F.col("_at"))).alias("_free_below"))
    told = rows.join(gaps, F.col("_slug") == F.col("_base"), "left")
    number = F.col("_nth") + F.coalesce(F.size(F.filter("_free_below", lambda below: below < F.col("_nth"))), F.lit(0))
    made = F.when(number == 1, F.col("_slug")).otherwise(F.concat_ws("_", "_slug", number.cast("string")))
    return told.select(*new.columns, F.when(F.col("_slug") != "", made).alias(key))


def aliases_contain(aliases: Column | str, query: str) -> Column:
    """One of the aliases contains the query, whatever the case."""
    return F.exists(aliases, lambda a: F.contains(F.lower(a), F.lit(query.lower())))

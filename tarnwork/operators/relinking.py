"""Stored results and the catalog they are linked to: matching again, edits, conflicts, and what an edit touches.

Matching all results again after each edit would read everything for a few names. An index from reading keys to printed
names tells which names an edit can touch: those with a key of a reading that the edit adds, drops or changes. Only their
results are matched again; all others stay as they are, and the outcome is that of matching everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import one_spaced, suggest_key, tidy_name
from tarnwork.operators.resolve import alias_key, catalog_readings, qualifiers_of, readings_of, resolve_names
from tarnwork.session import materialize


def active_tests(catalog: DataFrame) -> DataFrame:
    return catalog.where("is_active") if "is_active" in catalog.columns else catalog


def _identifier(c: Column | str) -> Column:
    return F.nullif(F.lower(one_spaced(F.coalesce(c, F.lit("")))), F.lit(""))


def printed_names(results: DataFrame, recorded: DataFrame, catalog: DataFrame) -> DataFrame:
    """``results(result_id, report_id, test_name, test, value, …)`` with ``printed, section, from_parser``.

    The name to match is the printed one of the row that was ``recorded(result_id, report_id, raw_test_name, test_name,
    display_name, value, section_context)`` for a result: the row of its id, else the only row of its report with its
    name and value. It counts while the stored name is still the recorded one or that of the linked test; a result whose
    user has renamed it is matched by its own name.
    """
    fields = F.struct("raw_test_name", "test_name", "display_name", "section_context").alias("_row")
    by_id = recorded.where("result_id IS NOT NULL").groupBy(F.col("result_id").alias("_id")).agg(F.max(fields).alias("_by_id"))
    names = F.array_distinct(F.array_compact(F.array(_identifier("display_name"), _identifier("test_name"))))
    keyed = recorded.select(F.col("report_id").alias("_report"), F.explode(names).alias("_name"), F.trim(F.coalesce("value", F.lit(""))).alias("_value"), fields)
    by_name = keyed.groupBy("_report", "_name", "_value").agg(F.count("*").alias("_n"), F.max("_row").alias("_by_name")).where("_n = 1").drop("_n")
    linked = catalog.groupBy(F.col("name").alias("_test")).agg(_identifier(F.min("display_name")).alias("_linked"))
    told = results.withColumn("_stored", _identifier("test_name")).withColumn("_own", F.trim(F.coalesce("value", F.lit(""))))
    told = told.join(by_id, F.col("result_id") == F.col("_id"), "left")
    told = told.join(by_name, (F.col("report_id") == F.col("_report")) & (F.col("_stored") == F.col("_name")) & (F.col("_own") == F.col("_value")), "left")
    told = told.join(linked, F.col("test") == F.col("_test"), "left").withColumn("_row", F.coalesce("_by_id", "_by_name"))
    known = F.coalesce(F.col("_stored") == _identifier("_row.display_name"), F.lit(False)) | F.coalesce(F.col("_stored") == _identifier("_row.test_name"), F.lit(False)) | F.coalesce(F.col("_stored") == F.col("_linked"), F.lit(False))
    counts = F.col("_row").isNotNull() & known
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    # Written once: matching again reads the names several times.
    return materialize(told.select(
        *results.columns, F.when(counts, first("_row.raw_test_name", "_row.display_name", "test_name")).otherwise(F.col("test_name")).alias("printed"),
        F.when(counts, F.nullif(F.col("_row.section_context"), F.lit(""))).alias("section"), counts.alias("from_parser"),
    ), "printed-names")


def relink(printed: DataFrame, catalog: DataFrame, *, links: DataFrame | None = None, tenant: str | None = None) -> DataFrame:
    """``printed``, as of ``printed_names``, with ``new_test, new_name, changed``.

    The new name is that of the test, else the printed one, tidy. A result has changed if its test has, or if its name
    has and came from a parser. ``links`` and ``tenant`` are as of ``resolve_names``. Without ``changed`` rows nothing
    is to be written: that is the dry run; ``relinked`` applies them.
    """
    names = active_tests(catalog)
    found = resolve_names(printed.withColumnRenamed("test", "_before"), names, key=["result_id"], context="section", unit="unit", value="value", links=links, tenant=tenant)
    shown = names.groupBy(F.col("name").alias("_name")).agg(F.min("display_name").alias("_shown"))
    told = found.join(shown, F.col("test") == F.col("_name"), "left")
    name = F.left(F.coalesce("_shown", tidy_name("printed")), F.lit(200))
    changed = ~F.col("_before").eqNullSafe(F.col("test")) | (F.col("from_parser") & ~F.col("test_name").eqNullSafe(name))
    return told.select(*[F.col("_before").alias("test") if c == "test" else F.col(c) for c in printed.columns], F.col("test").alias("new_test"), name.alias("new_name"), changed.alias("changed"))


def relinked(outcome: DataFrame, columns: list[str]) -> DataFrame:
    """The results after an outcome of ``relink``, by their own ``columns``."""
    new = {"test": F.when(F.col("changed"), F.col("new_test")).otherwise(F.col("test")), "test_name": F.when(F.col("changed"), F.col("new_name")).otherwise(F.col("test_name"))}
    return outcome.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def change_counts(outcome: DataFrame) -> DataFrame:
    """``printed, test_name, test, new_name, new_test, n`` of the results that change."""
    return outcome.where("changed").groupBy("printed", "test_name", "test", "new_name", "new_test").agg(F.count("*").alias("n"))


# --- Edits of the catalog ---------------------------------------------------------------------------------------------


def _read_as(rows: DataFrame, others: DataFrame, several: bool = False) -> DataFrame:
    """``name, text, other``: texts of ``rows`` that would be read as one of the tests ``others``, themselves not counted.

    As a name of a result would be: the first reading that fits exactly one of the other tests decides; with ``several``
    the first that fits any.
    """
    texts = rows.select(F.col("name").alias("_test"), F.explode(F.array_distinct(F.concat(F.array("name", "display_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("_text")).where("_text IS NOT NULL")
    asked = texts.withColumn("_with", qualifiers_of("_text")).select("_test", "_text", "_with", F.posexplode(readings_of("_text")).alias("_at", "_r"))
    # Of all tests that are read alike only the two smallest and greatest count, so many tests of one key make no pairs.
    ends = F.array_sort(F.array_distinct(F.array("_low", "_high")))
    alike = catalog_readings(others).groupBy("key", "required", "allowed").agg(F.min("test").alias("_low"), F.max("test").alias("_high"))
    rest = catalog_readings(others).join(alike, ["key", "required", "allowed"]).where((F.col("test") != F.col("_low")) & (F.col("test") != F.col("_high")))
    inner = rest.groupBy("key", "required", "allowed").agg(F.min("test").alias("_low"), F.max("test").alias("_high"))
    few = alike.unionByName(inner).select("key", "required", "allowed", F.explode(ends).alias("test"))
    fits = asked.join(few, (F.col("_r.key") == F.col("key")) & (F.col("_test") != F.col("test")))
    fits = fits.where((F.size(F.array_except("required", "_with")) == 0) & (F.size(F.array_except("_with", "allowed")) == 0))
    read = fits.groupBy("_test", "_text", "_at").agg(F.min("test").alias("test"), F.max("test").alias("_last")).where(F.lit(several) | (F.col("test") == F.col("_last")))
    return read.groupBy(F.col("_test").alias("name"), F.col("_text").alias("text")).agg(F.min_by("test", "_at").alias("other"))


def conflicting_names(catalog: DataFrame) -> DataFrame:
    """``name, text, other``: texts of an active test (its key, shown name or an alias) that would be read as another test.

    The catalog is joined with itself by reading keys; no pair of tests without a common key is looked at.
    """
    return _read_as(active_tests(catalog), active_tests(catalog))


def proposed(catalog: DataFrame, edits: DataFrame) -> DataFrame:
    """The catalog as the edits would leave it: rows of equal ``name`` are replaced, new ones added."""
    return catalog.join(edits.select("name"), "name", "left_anti").unionByName(edits.select(*catalog.columns))


def checked_edits(catalog: DataFrame, edits: DataFrame, units: DataFrame) -> DataFrame:
    """``edits`` with ``problem``: why a row can't be taken, or null.

    Both have ``name, display_name, aliases, default_unit, normal_min, normal_max, is_active``; an edit without a name
    gets one from its shown name. A name that would be read as a test which no edit replaces is refused. Of several edits
    of one key, or that claim one name, none is taken.
    """
    named = edits.withColumn("name", F.coalesce(F.nullif(F.lower(F.trim("name")), F.lit("")), suggest_key("display_name"))).withColumn("display_name", one_spaced("display_name"))
    known = units.select(F.col("name").alias("default_unit")).distinct().withColumn("_unit", F.lit(True))
    repeated = named.groupBy("name").agg(F.count("*").alias("_n"))
    claims = active_tests(named.dropDuplicates(["name"]))
    clashes = _read_as(claims, active_tests(catalog.join(named, "name", "left_anti"))).unionByName(_read_as(claims, claims, several=True))
    clash = clashes.groupBy("name").agg(F.min(F.struct("other", "text")).alias("_clash"))
    told = named.join(known, "default_unit", "left").join(repeated, "name").join(clash, "name", "left")
    problem = (
        F.when(F.coalesce("display_name", F.lit("")) == "", "no name to show")
        .when(~F.coalesce("name", F.lit("")).rlike("^[a-z0-9_]+$"), "no key").when(F.col("_n") > 1, "repeated key")
        .when(F.col("_unit").isNull(), "unknown unit").when(F.col("normal_min") > F.col("normal_max"), "range upside down")
        .when(F.col("is_active") & F.col("_clash").isNotNull(), F.concat(F.lit("names "), F.col("_clash.other")))
    )
    return told.select(*edits.columns, problem.alias("problem"))


def touched(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reading keys, and the tests, whose rows differ between two states of a catalog."""

    def rows(catalog: DataFrame) -> DataFrame:
        tests = active_tests(catalog)
        return catalog_readings(tests).join(tests.select(F.col("name").alias("test"), "display_name"), "test").select("key", "test", F.array_join("required", ",").alias("required"), F.array_join("allowed", ",").alias("allowed"), "display_name")

    old, new = rows(before), rows(after)
    differs = old.exceptAll(new).unionByName(new.exceptAll(old))
    return differs.select("key").distinct(), differs.select("test").distinct()


def name_index(names: DataFrame, *, printed: str = "printed") -> DataFrame:
    """``key, printed``: each distinct name under the key of each of its readings. Keep it as a table, and add new names to it."""
    distinct = names.select(F.col(printed).alias("printed")).distinct()
    return distinct.select(F.explode(readings_of("printed")).alias("_r"), "printed").select("_r.key", "printed")


def relink_touched(printed: DataFrame, index: DataFrame, before: DataFrame, after: DataFrame, *, links: DataFrame | None = None, tenant: str | None = None) -> DataFrame:
    """As ``relink`` of all of ``printed`` to the catalog ``after``, by way of the results that an edit can touch.

    ``printed`` must be linked as the catalog ``before`` says, and ``index`` hold its names, as of ``name_index``.
    Results linked to a test that has changed are touched too, as are names that a tenant has linked to one. Rows that
    aren't touched come out unchanged.
    """
    keys, tests = touched(before, after)
    names = index.join(keys, "key", "left_semi").select("printed").distinct()
    by_name = printed.join(names, "printed", "left_semi").select("result_id")
    by_test = printed.join(tests, "test", "left_semi").select("result_id")
    ids = by_name.unionByName(by_test)
    if links is not None and tenant:
        own = links.join(tests, "test", "left_semi").select(F.col(tenant).alias("_tenant"), "match_key").distinct()
        same = (F.col(tenant) == F.col("_tenant")) & (alias_key("printed") == F.col("match_key"))
        ids = ids.unionByName(printed.join(own, same, "left_semi").select("result_id"))
    marked = materialize(printed.join(ids.distinct().withColumn("_touched", F.lit(True)), "result_id", "left"), "touched-names").select(*printed.columns, "_touched")
    some = relink(marked.where("_touched").drop("_touched"), after, links=links, tenant=tenant)
    rest = marked.where("_touched IS NULL").drop("_touched")
    return some.unionByName(rest.withColumns({"new_test": F.col("test"), "new_name": F.col("test_name"), "changed": F.lit(False)}))

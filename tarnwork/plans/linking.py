"""Catalog edits and matching again over the demonstration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import relinking
from tarnwork.plans._read import read
from tarnwork.plans.analytics import query

_COLUMNS = ("name", "display_name", "aliases", "default_unit", "normal_min", "normal_max", "is_active")


def _tests(names: DataFrame, shown: str, *aliases) -> DataFrame:
    """A catalog from a column of names."""
    listed = F.array(*aliases) if aliases else F.array().cast("array<string>")
    return names.select(F.translate(F.lower(shown), " #", "__").alias("name"), F.col(shown).alias("display_name"), listed.alias("aliases"), F.lit("each").alias("default_unit"), F.lit(1).alias("normal_min"), F.lit(2).alias("normal_max"), F.lit(True).alias("is_active"))


def _catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tests named by parts, and the same after edits.

    Cold ones are switched off, small ones are shown under another name, and each type of a brand of an even number
    becomes a test.
    """
    part = read(spark, sf_dir, "part")
    before = _tests(part.select("p_name").distinct(), "p_name")
    shown = F.when(F.col("display_name").startswith("small "), F.concat("display_name", F.lit(" level"))).otherwise(F.col("display_name"))
    edited = before.withColumns({"display_name": shown, "is_active": ~F.col("display_name").startswith("cold ")})
    new = part.where(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 2 == 0).select(F.concat_ws(" ", "p_type", "p_brand").alias("kind")).distinct()
    return before, edited.unionByName(_tests(new, "kind"))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A result for each line item, linked by its part's name or not linked by its part's type and brand, and the rows recorded for them.

    Every seventh result was renamed by its user.
    """
    # Some line numbers occur twice in an order.
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity")).alias("l")).select("l_orderkey", "l_linenumber", "l.*")
    rows = lines.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    by_name = F.col("l_linenumber") % 2 == 0
    printed = F.when(by_name, F.concat(F.upper("p_name"), F.lit(", SERUM"))).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    id_ = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id")
    name = F.when(F.col("l_partkey") % 7 == 0, F.lit("my own name")).when(by_name, F.col("p_name")).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    test = F.when(by_name & (F.col("l_partkey") % 7 != 0), F.translate("p_name", " ", "_"))
    value = F.col("l_quantity").cast("int").cast("string").alias("value")
    results = rows.select(id_, F.col("l_orderkey").alias("report_id"), name.alias("test_name"), test.alias("test"), value, F.lit("mg/dL").alias("unit"), printed.alias("_printed"))
    recorded = results.select("result_id", "report_id", F.col("_printed").alias("raw_test_name"), F.when(F.col("test").isNotNull(), F.replace("test", F.lit("_"), F.lit(" "))).otherwise(F.col("_printed")).alias("display_name"), F.lit(None).cast("string").alias("test_name"), "value", F.lit("").alias("section_context"))
    return results.drop("_printed"), recorded


_RELINKED = """
    WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS result_id, p_name, p_type || ' ' || p_brand AS kind, l_linenumber % 2 = 0 AS by_name, l_partkey % 7 = 0 AS own, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 2 = 0 AS even
               FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1) JOIN part ON l_partkey = p_partkey),
    t AS (SELECT *, CASE WHEN own OR NOT by_name THEN NULL ELSE replace(p_name, ' ', '_') END AS test,
                 CASE WHEN own THEN NULL WHEN by_name THEN CASE WHEN p_name LIKE 'cold %' THEN NULL ELSE replace(p_name, ' ', '_') END WHEN even THEN replace(replace(lower(kind), ' ', '_'), '#', '_') END AS new_test FROM r)
    SELECT result_id, test, new_test, CASE WHEN own THEN 'my own name' WHEN by_name THEN CASE WHEN p_name LIKE 'cold %' THEN upper(p_name) || ', SERUM' WHEN p_name LIKE 'small %' THEN p_name || ' level' ELSE p_name END ELSE kind END AS new_name,
           NOT own AND (test IS DISTINCT FROM new_test OR (by_name AND p_name LIKE 'small %')) AS changed FROM t
"""


@query(_RELINKED)
def relinked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results matched again after edits, by way of those that the edits can touch."""
    before, after = _catalogs(spark, sf_dir)
    printed = relinking.printed_names(*_results(spark, sf_dir), after)
    return relinking.relink_touched(printed, relinking.name_index(printed), before, after).select("result_id", "test", "new_test", "new_name", "changed")


@query(f"""
    WITH o AS ({_RELINKED})
    SELECT test, new_test, new_name, count(*) AS n FROM o WHERE changed GROUP BY ALL
""")
def relink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each change occurs when all results are matched again: the dry run."""
    printed = relinking.printed_names(*_results(spark, sf_dir), _catalogs(spark, sf_dir)[1])
    return relinking.change_counts(relinking.relink(printed, _catalogs(spark, sf_dir)[1])).groupBy("test", "new_test", "new_name").agg(F.sum("n").alias("n"))


@query("""
    WITH t AS (SELECT p_name, arg_min(p_type || ' ' || p_brand, p_partkey) AS alias FROM part GROUP BY p_name), n AS (SELECT alias, count(*) AS n FROM t GROUP BY alias)
    SELECT replace(a.p_name, ' ', '_') AS name, a.alias AS text, replace(b.p_name, ' ', '_') AS other FROM t a JOIN n USING (alias) JOIN t b ON a.alias = b.alias AND a.p_name <> b.p_name WHERE n = 2
""")
def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests named by parts, with the type and brand of their first part as an alias, that would be read as another test; an alias of three tests is read as none."""
    rows = read(spark, sf_dir, "part").groupBy("p_name").agg(F.min_by(F.concat_ws(" ", "p_type", "p_brand"), "p_partkey").alias("alias"))
    return relinking.conflicting_names(_tests(rows, "p_name", "alias"))


@query("""
    WITH e AS (SELECT s_suppkey, s_suppkey % 4 AS k, CASE WHEN s_suppkey % 16 = 14 THEN s_suppkey - 8 ELSE s_suppkey + 8 END AS partner FROM supplier)
    SELECT s_suppkey, CASE WHEN k = 0 THEN 'range upside down' WHEN k = 1 THEN 'unknown unit' WHEN s_suppkey % 8 = 2 THEN 'names ' || (SELECT min(replace(p_name, ' ', '_')) FROM part)
                          WHEN k = 2 AND partner IN (SELECT s_suppkey FROM supplier) THEN 'names own_x' || partner || 'y' END AS problem FROM e
""")
def checked_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new test for each supplier: some with a bad range, an unknown unit, an alias that names a part's test, or one that two of them claim."""
    before, _ = _catalogs(spark, sf_dir)
    first = read(spark, sf_dir, "part").agg(F.min("p_name").alias("first"))
    k = F.col("s_suppkey") % 4
    # Two suppliers of numbers eight apart claim one name.
    claimed = F.concat(F.lit("Shared z"), F.when(F.col("s_suppkey") % 16 == 14, F.col("s_suppkey") - 8).otherwise(F.col("s_suppkey")).cast("string"), F.lit("q"))
    edits = read(spark, sf_dir, "supplier").crossJoin(F.broadcast(first)).select(
        "s_suppkey", F.lit(None).cast("string").alias("name"), F.concat(F.lit("Own x"), F.col("s_suppkey").cast("string"), F.lit("y")).alias("display_name"), F.when(F.col("s_suppkey") % 8 == 2, F.array("first")).when(k == 2, F.array(claimed)).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.when(k == 1, "furlong").otherwise("each").alias("default_unit"), F.when(k == 0, 9).otherwise(1).alias("normal_min"), F.lit(2).alias("normal_max"), F.lit(True).alias("is_active"),
    )
    units = read(spark, sf_dir, "region").select(F.lit("each").alias("name")).distinct()
    return relinking.checked_edits(before, edits, units).select("s_suppkey", "problem")

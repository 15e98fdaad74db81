"""Several trends at once over the demonstration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.operators import trends
from tarnwork.plans._read import read
from tarnwork.plans.analytics import _CONVERSIONS, query
from tarnwork.plans.linking import _tests
from tarnwork.session import materialize

_FIELDS = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")

_SQL = """
    r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_returnflag, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value, CAST(l_quantity AS INT) AS q, p_name, l_partkey % 3 <> 0 AS linked
          FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag, l_shipdate) = 1) JOIN part ON l_partkey = p_partkey),
    n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_name) AS k, count(*) OVER (PARTITION BY l_suppkey) AS names FROM (SELECT DISTINCT l_suppkey, p_name FROM r)),
    -- More than ten: a supplier of a number divisible by five asks for all its names, and for the first two in other ways.
    s AS (SELECT * FROM n WHERE k <= 3 AND NOT (l_suppkey % 5 = 0 AND names + 2 > 10)),
    j AS (SELECT r.*, k FROM r JOIN s USING (l_suppkey, p_name) WHERE k = 2 OR linked = (k = 1)),
    c AS (SELECT l_suppkey, k, l_returnflag, count(*) AS n, min((l_shipdate, l_orderkey, l_linenumber)) AS seen FROM j GROUP BY ALL),
    u AS (SELECT l_suppkey, k, l_returnflag AS target FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey, k ORDER BY n DESC, (l_returnflag = 'N' AND k < 3) DESC, seen) = 1),
    f(src, dst, factor) AS (VALUES ('R', 'N', 1.37), ('A', 'N', 10.1), ('N', 'R', 0.7299)),
    p AS (SELECT j.*, target, factor, CAST(q * factor AS DECIMAL(20, 6)) AS x FROM j JOIN u USING (l_suppkey, k) LEFT JOIN f ON src = l_returnflag AND dst = target AND k < 3),
    t AS (SELECT *, CASE WHEN x < 1 THEN CAST(CAST(x AS DECIMAL(20, 3)) AS VARCHAR) WHEN x < 100 THEN CAST(CAST(x AS DECIMAL(20, 2)) AS VARCHAR) WHEN x < 1000 THEN CAST(CAST(x AS DECIMAL(20, 1)) AS VARCHAR) ELSE CAST(CAST(x AS DECIMAL(20, 0)) AS VARCHAR) END AS d,
                 CASE WHEN l_returnflag = target THEN 'same' WHEN factor IS NOT NULL THEN 'converted' ELSE 'unconverted' END AS unit_status FROM p)
"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results by supplier, the series that suppliers ask for, and factors.

    Each asks for its first name as a test and again as a typed search, for the second by a typed search, for the third
    as a name without a test, and for a test that isn't there; those of numbers divisible by five for all their names.
    """
    part = read(spark, sf_dir, "part")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*_FIELDS)).alias("l")).select("l_orderkey", "l_linenumber", "l.*")
    rows = lines.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    linked = F.col("l_partkey") % 3 != 0
    results = rows.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag", F.col("l_quantity").cast("int").cast("string").alias("value"), F.lit("10 - 40").alias("printed"),
        F.when(linked, F.translate("p_name", " ", "_")).alias("test"), F.when(linked, F.col("p_name")).otherwise(F.initcap("p_name")).alias("test_name"), "p_name",
    )
    names = results.select("l_suppkey", "p_name").distinct().withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("p_name")))
    one = lambda at, kind, value: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), value.alias("value"))
    test, typed = F.translate("p_name", " ", "_"), F.upper("p_name")
    ways = F.when(F.col("k") == 1, F.array(one(1, "parameter", typed), one(2, "test_type", test), one(5, "test_type", F.lit("no_such_test")), one(6, "name", F.lit("  "))))
    ways = ways.when(F.col("k") == 2, F.array(one(3, "parameter", typed))).when(F.col("k") == 3, F.array(one(4, "name", F.concat(typed, F.lit(", Serum")))))
    ways = ways.when(F.col("l_suppkey") % 5 == 0, F.array(F.struct((F.col("k") + 6).alias("at"), F.lit("name").alias("kind"), F.col("p_name").alias("value"))))
    asked = names.where(ways.isNotNull()).select("l_suppkey", F.explode(ways).alias("a")).select("l_suppkey", "a.*")
    catalog = _tests(part.select("p_name").distinct(), "p_name").withColumn("default_unit", F.lit("N"))
    by_test = F.array(*[F.struct(F.lit(a.lower()).alias("from_key"), F.lit(b.lower()).alias("to_key"), F.lit(x).cast("decimal(15,8)").alias("factor")) for _, a, b, x in _CONVERSIONS])
    factors = catalog.select(F.col("name").alias("test_type"), F.explode(by_test).alias("f")).select("test_type", "f.*")
    return results, trends.asked_series(asked, catalog, tenant="l_suppkey"), factors


def _points(results: DataFrame, asked: DataFrame, factors: DataFrame) -> DataFrame:
    return trends.several_trends(results, asked, factors, tenant="l_suppkey", test="test", name="test_name", unit="l_returnflag", value="value", printed_range="printed", order=["l_shipdate", "l_orderkey", "l_linenumber"])


@query(f"""
    WITH {_SQL}
    SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN k = 3 THEN upper(p_name) || ', Serum' ELSE p_name END AS trend_name, CASE WHEN unit_status = 'unconverted' THEN l_returnflag ELSE target END AS trend_unit,
           CASE WHEN unit_status = 'converted' THEN CASE WHEN contains(d, '.') THEN rtrim(rtrim(d, '0'), '.') ELSE d END ELSE value END AS trend_value, unit_status
    FROM t
""")
def several_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of the trends that suppliers ask for."""
    return _points(*_asked(spark, sf_dir)).select("l_suppkey", "l_orderkey", "l_linenumber", "trend_name", "trend_unit", "trend_value", "unit_status")


@query(f"""
    WITH {_SQL},
    h AS (SELECT l_suppkey, k, any_value(target) AS unit, count(*) AS points, count(*) FILTER (unit_status = 'unconverted') AS unconverted FROM t GROUP BY ALL)
    SELECT s.l_suppkey, CASE k WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS at, CASE WHEN k = 3 THEN upper(p_name) || ', Serum' ELSE p_name END AS trend_name, CASE WHEN k < 3 THEN replace(p_name, ' ', '_') END AS trend_test,
           coalesce(unit, '') AS unit, coalesce(points, 0) AS points, coalesce(unconverted, 0) AS unconverted, NULL AS problem
    FROM s LEFT JOIN h USING (l_suppkey, k)
    UNION ALL SELECT DISTINCT l_suppkey, 5, 'no_such_test', NULL, '', 0, 0, NULL FROM s
    UNION ALL SELECT DISTINCT l_suppkey, 1, NULL, NULL, '', 0, 0, 'more than 10 trends' FROM n WHERE l_suppkey % 5 = 0 AND names + 2 > 10
""")
def trend_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trends that suppliers ask for, with their units and numbers of points; one asked for twice comes once."""
    results, asked, factors = _asked(spark, sf_dir)
    # Few rows, which the points and their heads are both made of.
    asked = materialize(asked, "asked-series")
    heads = trends.trend_heads(_points(results, asked, factors), asked, tenant="l_suppkey")
    return heads.select("l_suppkey", "at", "trend_name", "trend_test", "unit", "points", "unconverted", "problem")

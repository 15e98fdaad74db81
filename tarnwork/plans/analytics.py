"""Summaries, windows, search and status over the demonstration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import dates, numbers, status
from tarnwork.functions.text import contains_words, natural_key, normalize_identifier, suggest_key, tidy_name
from tarnwork.operators import series, summaries, timeline
from tarnwork.plans._read import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""
    SELECT user_id, 'type:' || event_type AS parameter, count(*) AS result_count, count(value) AS numeric_count, event_type AS printed_names, event_type AS name
    FROM events GROUP BY user_id, event_type
""")
def parameter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by tenant and parameter."""
    found = summaries.parameter_summary(read(spark, sf_dir, "events"), tenant=["user_id"], test="event_type", display="event_type", printed="event_type", value="value", name_key=F.col("event_type"))
    return found.withColumn("printed_names", F.array_join("printed_names", ","))


@query("""
    SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
           (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers
    FROM nation
""")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return summaries.child_counts(nation, {"customers": (read(spark, sf_dir, "customer"), "c_nationkey"), "suppliers": (read(spark, sf_dir, "supplier"), "s_nationkey")}, key="n_nationkey")


@query("""
    WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min((l_orderkey, l_linenumber)) AS seen FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, lower(l_returnflag) AS unit_key, l_returnflag AS unit_label FROM c
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag = 'N' DESC, seen) = 1
""")
def dominant_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dominant_unit(read(spark, sf_dir, "lineitem"), series=["l_suppkey"], unit="l_returnflag", order=["l_orderkey", "l_linenumber"], default=F.lit("N"))


_CONVERSIONS = [("all", "R", "N", "1.37000000"), ("all", "A", "N", "10.10000000"), ("all", "N", "R", "0.72990000")]


@query("""
    WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n, min((l_orderkey, l_linenumber)) AS seen FROM lineitem GROUP BY ALL),
    u AS (SELECT l_partkey, l_returnflag AS target FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag = 'N' DESC, seen) = 1),
    f(src, dst, factor) AS (VALUES ('R', 'N', 1.37), ('A', 'N', 10.1), ('N', 'R', 0.7299)),
    p AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, target, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value, CAST(CAST(l_quantity AS INT) * factor AS DECIMAL(20, 6)) AS x, factor
      FROM lineitem JOIN u USING (l_partkey) LEFT JOIN f ON src = l_returnflag AND dst = target),
    t AS (SELECT *, CASE WHEN x < 1 THEN CAST(CAST(x AS DECIMAL(20, 3)) AS VARCHAR) WHEN x < 100 THEN CAST(CAST(x AS DECIMAL(20, 2)) AS VARCHAR) WHEN x < 1000 THEN CAST(CAST(x AS DECIMAL(20, 1)) AS VARCHAR) ELSE CAST(CAST(x AS DECIMAL(20, 0)) AS VARCHAR) END AS s FROM p)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = target OR factor IS NOT NULL THEN target ELSE l_returnflag END AS trend_unit,
           CASE WHEN l_returnflag <> target AND factor IS NOT NULL THEN CASE WHEN contains(s, '.') THEN rtrim(rtrim(s, '0'), '.') ELSE s END ELSE value END AS trend_value,
           CASE WHEN l_returnflag = target THEN 'same' WHEN factor IS NOT NULL THEN 'converted' ELSE 'unconverted' END AS unit_status
    FROM t
""")
def trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's quantities in one unit."""
    conversions = spark.createDataFrame([(*r[:3], r[3], True) for r in _CONVERSIONS], "test_type string, from_unit string, to_unit string, conversion_factor string, is_active boolean").withColumn("conversion_factor", F.col("conversion_factor").cast("decimal(15,8)"))
    units = spark.createDataFrame([(u, u) for u in "RAN"], "name string, symbol string")
    results = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("int").cast("string").alias("value"), F.lit("all").alias("test_type"), F.lit("10 - 40").alias("printed"))
    points = series.trend_points(results, series.conversion_factors(conversions, units), series=["l_partkey"], test="test_type", unit="l_returnflag", value="value", printed_range="printed", order=["l_orderkey", "l_linenumber"], default=F.lit("N"))
    return points.select("l_orderkey", "l_linenumber", "trend_unit", "trend_value", "unit_status")


@query("""
    WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE value IS NOT NULL),
    m AS (SELECT user_id, count(*) AS n, avg(value) FILTER (pos <= total // 2) AS a, avg(value) FILTER (pos > total // 2) AS b FROM r GROUP BY user_id),
    c AS (SELECT *, CASE WHEN n < 2 OR a = 0 THEN 0.0 ELSE (b - a) / a * 100 END AS change FROM m)
    SELECT user_id, n, round(a, 6) AS first_mean, round(b, 6) AS second_mean, round(change, 6) AS change_pct,
           CASE WHEN abs(change) < 5 THEN 'STABLE' WHEN (change > 0) = (user_id % 2 = 1) THEN 'IMPROVING' ELSE 'DETERIORATING' END AS trend
    FROM c
""")
def half_split_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with odd ids are better off with higher values."""
    points = read(spark, sf_dir, "events").withColumn("higher", F.col("user_id") % 2 == 1)
    found = series.half_split(points, higher_is_better="higher", series=["user_id"], order=["ts", "event_id"], value="value")
    return found.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("first_mean", "second_mean", "change_pct")], "trend")


@query("""
    SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous_id, lead(o_orderkey) OVER w AS next_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY o_custkey) AS total
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return series.neighbours(rows, partition=["o_custkey"], order=[F.desc("o_orderdate"), F.desc("o_orderkey")], id="o_orderkey").drop("o_orderdate")


@query("""
    WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS s, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE), o_orderstatus ORDER BY o_orderkey) AS reading FROM orders)
    SELECT o_custkey, CAST(day AS VARCHAR) AS day, reading, max(v) FILTER (s = 'F') AS f, max(v) FILTER (s = 'O') AS o, max(v) FILTER (s = 'P') AS p FROM r GROUP BY o_custkey, day, reading
""")
def aligned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values by status side by side, by customer and day."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("day"), F.lower("o_orderstatus").alias("s"), "o_orderkey", "o_totalprice")
    return series.aligned_table(rows, keys=["o_custkey"], date="day", series="s", value="o_totalprice", names=["f", "o", "p"], order=["o_orderkey"])


@query("""
    SELECT event_type, min(value) AS low, max(value) AS high, round(min(value) - (max(value) - min(value)) * 0.1, 6) AS axis_low, round(max(value) + (max(value) - min(value)) * 0.1, 6) AS axis_high FROM events GROUP BY event_type
""")
def series_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.series_span(read(spark, sf_dir, "events"), series=["event_type"], value="value")
    return found.select("event_type", "low", "high", F.round("axis_low", 6).alias("axis_low"), F.round("axis_high", 6).alias("axis_high"))


@query("""
    SELECT conv_id, turn, role, length(text) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 3
""")
def chat_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.last_per_group(read(spark, sf_dir, "conversations"), keys=["conv_id"], order=[F.desc("turn"), F.asc("role"), F.asc("text")], most=3)
    return found.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM c QUALIFY rank <= 2
""")
def commonest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.commonest(read(spark, sf_dir, "events"), keys=["user_id"], of="event_type", most=2)


@query("""
    WITH f AS (SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_brand), 'small'))
    SELECT *, (SELECT count(*) FROM f) > 200 AS truncated FROM f ORDER BY p_name, p_partkey LIMIT 200
""")
def search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 parts with a word in name or brand, and whether there are more."""
    return summaries.search(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "SMALL", ["p_name", "p_brand"], order=[F.asc("p_name"), F.asc("p_partkey")], limit=200)


@query("""
    SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'widget') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'economy')
""")
def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(contains_words(F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.lit("Widget economy"))).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.page(read(spark, sf_dir, "customer"), order=[F.desc("c_acctbal"), F.asc("c_custkey")], number=2).select("c_custkey", "c_name")


@query("""
    SELECT o_orderpriority, count(*) AS "all", count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS pending FROM orders GROUP BY o_orderpriority
""")
def status_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.bucket_counts(read(spark, sf_dir, "orders"), keys=["o_orderpriority"], status="o_orderstatus", buckets={"done": ["F"], "pending": ["O", "P"]})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def change_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.change_histogram(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""
    SELECT l_suppkey, CASE WHEN count(DISTINCT l_shipyear) = 1 THEN min(l_shipyear) END AS shared_range FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS VARCHAR) AS l_shipyear FROM lineitem) GROUP BY l_suppkey
""")
def shared_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("string").alias("year"))
    return summaries.shared_range(rows, series=["l_suppkey"], printed="year")


_TIMELINE = """
    WITH e AS (
      SELECT o_custkey AS tenant, CAST(o_orderdate AS DATE) AS day, 'order' AS kind, 'Order ' || o_orderkey AS text FROM orders
      UNION ALL SELECT user_id, CAST(ts AS DATE), 'event', event_type FROM events)
"""


def _events(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("text"))
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), F.to_date("ts").alias("day"), F.col("event_type").alias("text"))
    return timeline.timeline({"order": orders, "event": events}, today=F.lit("2000-06-30").cast("date"), period=period)


@query(f"{_TIMELINE} SELECT tenant, kind, count(*) AS n FROM e WHERE day >= DATE '2000-06-30' - 730 GROUP BY tenant, kind")
def timeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of both kinds in the two years before a day, by tenant."""
    return timeline.timeline_counts(_events(spark, sf_dir, "2y"))


@query(f"""{_TIMELINE}, d AS (SELECT tenant, day, string_agg(text, '; ' ORDER BY text) AS line FROM e GROUP BY tenant, day)
    SELECT tenant, string_agg(CAST(day AS VARCHAR) || ': ' || line, chr(10) ORDER BY day) AS text FROM d GROUP BY tenant""")
def timeline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.timeline_text(_events(spark, sf_dir, "all"))


@query("""
    SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-07-01' OR o_orderstatus = 'O' OR o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1999-07-01'
""")
def active_in_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that overlap a period: orders with thirty days to run, open ones without end."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("end"), (F.col("o_orderstatus") == "O").alias("ongoing"))
    return rows.where(timeline.overlaps_period(F.lit("1999-07-01").cast("date"), "o_orderdate", "end", "ongoing")).select("o_orderkey")


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 1 THEN 'INVALID_MIN' WHEN l_quantity > 49 THEN 'INVALID_MAX' WHEN l_quantity < 3 THEN 'CRITICAL_LOW' WHEN l_quantity > 45 THEN 'CRITICAL_HIGH' WHEN l_quantity < 10 THEN 'LOW' WHEN l_quantity > 40 THEN 'HIGH' ELSE 'NORMAL' END AS status
    FROM lineitem
""")
def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = {"min_value": 1, "max_value": 49, "critical_low_min": 3, "critical_high_max": 45, "normal_min": 10, "normal_max": 40}
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.rule_status("l_quantity", {k: F.lit(v) for k, v in bounds.items()}).alias("status"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_quantity < 10 THEN 'LOW' WHEN l_quantity > 40 THEN 'HIGH' ELSE 'NORMAL' END
      WHEN 'R' THEN CASE WHEN l_quantity >= 25 THEN 'HIGH' ELSE 'NORMAL' END ELSE CASE WHEN l_quantity <= 25 THEN 'LOW' ELSE 'NORMAL' END END AS status
    FROM lineitem
""")
def range_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against printed ranges of three kinds."""
    printed = F.when(F.col("l_returnflag") == "A", "10 - 40").when(F.col("l_returnflag") == "R", "< 25").otherwise("> 25")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.range_status(F.col("l_quantity").cast("string"), printed).alias("status"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity * 0.1234567, 4) AS DOUBLE) AS converted FROM lineitem")
def convert_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.convert_exact("l_quantity", F.lit("0.1234567").cast("decimal(15,8)")).cast("double").alias("converted"))


@query("""
    SELECT p_partkey, lower(trim(p_name)) AS identifier, regexp_replace(lower(p_type || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g').trim('_') AS key, p_brand || ' -,' AS tidy,
           regexp_replace(lower(p_brand), '([0-9]+)', 'x', 'g') || lpad(regexp_extract(p_brand, '[0-9]+'), 20, '0') AS sort_key
    FROM part
""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names normalised, as keys, tidied, and for natural order."""
    plain = natural_key("p_brand")
    sort_key = F.concat(F.regexp_replace(plain, r"\d+", "x"), F.regexp_extract(plain, r"(\d+)", 1))
    return read(spark, sf_dir, "part").select("p_partkey", normalize_identifier(F.concat(F.lit("  "), F.col("p_name"))).alias("identifier"), suggest_key(F.concat(F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(")"))).alias("key"), tidy_name(F.concat(F.col("p_brand"), F.lit(" -,."))).alias("tidy"), sort_key.alias("sort_key"))


@query("""
    SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso, CAST(date_part('year', DATE '2001-03-01') - year(o_orderdate) - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) > 301 THEN 1 ELSE 0 END AS INT) AS age FROM orders
""")
def dates_and_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates printed in three ways and read back, and completed years."""
    d = F.col("o_orderdate")
    printed = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd HH:mm")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "d MMM yyyy"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.flexible_date(printed).cast("string").alias("iso"), dates.age(F.to_date(d), F.lit("2001-03-01").cast("date")).alias("age"))


@query("""
    WITH s AS (SELECT event_type, max(value) - min(value) AS span, min(value) AS low, max(value) AS high FROM events GROUP BY event_type),
    r AS (SELECT *, pow(10, floor(log10(span / 5))) AS power FROM s)
    SELECT event_type, CASE WHEN span / 5 / power <= 1 THEN 1 WHEN span / 5 / power <= 2 THEN 2 WHEN span / 5 / power <= 2.5 THEN 2.5 WHEN span / 5 / power <= 5 THEN 5 ELSE 10 END * power AS step,
           round((100 - (low - span * 0.1)) / (span * 1.2), 6) AS at_100 FROM r
""")
def axis_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = read(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return spans.select("event_type", numbers.nice_step(F.col("high") - F.col("low")).alias("step"), F.round(numbers.indexed(F.lit(100.0), "low", "high"), 6).alias("at_100"))

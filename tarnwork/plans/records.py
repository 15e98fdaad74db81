"""Catalog lookups and changes of records over the demonstration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.dates import date_time_text, local_day
from tarnwork.functions.text import redact_names
from tarnwork.operators import catalog, context, records, scoring
from tarnwork.plans._read import read
from tarnwork.plans.analytics import query

_UNITS = [("each", "ea"), ("dozen", "dz"), ("ea", "xx")]
_CONVERSIONS = [("N", "each", "dozen", "0.08333333", "12.00000000", True), ("N", "dozen", "each", "12.00000000", "0.08333333", True), ("R", "each", "dozen", "0.10000000", "10.00000000", False)]
_TYPE_UNITS = [("N", "each", "10", "40", True), ("N", "dozen", "1", "3", True), ("R", "each", "5", "30", True), ("R", "dozen", "1", "2", False)]
_RULES = [("N", "each", "0", "50", "10", "40", "3", "48", True), ("N", "dozen", "0", "5", "1", "4", None, None, True), ("R", "dozen", "0", "5", "1", "4", None, None, True)]


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    units = spark.createDataFrame(_UNITS, "name string, symbol string")
    conversions = spark.createDataFrame(_CONVERSIONS, "test string, from_unit string, to_unit string, conversion_factor string, reverse_factor string, is_active boolean")
    conversions = conversions.withColumns({c: F.col(c).cast("decimal(15,8)") for c in ("conversion_factor", "reverse_factor")})
    type_units = spark.createDataFrame(_TYPE_UNITS, "test string, unit string, normal_min string, normal_max string, is_active boolean")
    bounds = ("min_value", "max_value", "normal_min", "normal_max", "critical_low_min", "critical_high_max")
    rules = spark.createDataFrame(_RULES, f"test string, unit string, {', '.join(f'{b} string' for b in bounds)}, is_active boolean")
    cast = lambda frame: frame.withColumns({c: F.col(c).cast("decimal(18,4)") for c in frame.columns if c in bounds})
    return units, conversions, cast(type_units), cast(rules)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_linenumber") % 3 == 0, "ea").when(F.col("l_linenumber") % 3 == 1, "each").otherwise("dz")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("test"), unit.alias("unit"), F.col("l_quantity").cast("int").cast("string").alias("value"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'ea' WHEN l_linenumber % 3 = 1 THEN 'each' ELSE 'dozen' END AS unit_name FROM lineitem
""")
def found_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by name, else by symbol; ``ea`` is a name and a symbol."""
    return catalog.unit_names(_results(spark, sf_dir), _tables(spark)[0], unit="unit").select("l_orderkey", "l_linenumber", "unit_name")


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS test, CASE WHEN l_linenumber % 3 = 2 THEN 'dozen' ELSE 'each' END AS unit, CAST(l_quantity AS INT) AS v FROM lineitem),
    s AS (SELECT *, CASE WHEN test = 'N' THEN 'rule' WHEN test = 'R' AND unit = 'dozen' THEN 'rule' WHEN test = 'R' THEN 'unit' END AS rule_source FROM r),
    t AS (SELECT *, CASE WHEN test = 'N' AND unit = 'each' THEN CASE WHEN v > 50 THEN 'INVALID_MAX' WHEN v < 3 THEN 'CRITICAL_LOW' WHEN v > 48 THEN 'CRITICAL_HIGH' WHEN v < 10 THEN 'LOW' WHEN v > 40 THEN 'HIGH' ELSE 'NORMAL' END
        WHEN rule_source = 'rule' THEN CASE WHEN v > 5 THEN 'INVALID_MAX' WHEN v < 1 THEN 'LOW' WHEN v > 4 THEN 'HIGH' ELSE 'NORMAL' END
        WHEN rule_source = 'unit' THEN CASE WHEN v < 5 THEN 'LOW' WHEN v > 30 THEN 'HIGH' ELSE 'NORMAL' END END AS status FROM s)
    SELECT l_orderkey, l_linenumber, rule_source, status, CASE WHEN status IS NULL THEN '' WHEN status LIKE '%HIGH' THEN 'HIGH' WHEN status LIKE '%LOW' THEN 'LOW' WHEN status = 'NORMAL' THEN 'NORMAL' ELSE '' END AS stored FROM t
""")
def validated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values against the rule of test and unit, else the unit's normal range."""
    units, _, type_units, rules = _tables(spark)
    rows = _results(spark, sf_dir).withColumn("unit", F.when(F.col("unit") == "dz", "dozen").otherwise("each"))
    return catalog.validate_results(rows, rules, type_units).select("l_orderkey", "l_linenumber", "rule_source", "status", "stored")


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS test, CASE WHEN l_linenumber % 2 = 0 THEN 'dozen' ELSE 'other' END AS unit, l_linenumber % 5 = 0 AS worded, CAST(l_quantity AS INT) AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN test = 'A' OR worded THEN 'UNKNOWN' WHEN unit = 'dozen' OR test = 'R' THEN CASE WHEN test = 'R' AND unit = 'other' THEN 'UNKNOWN' WHEN v > 5 THEN 'INVALID_MAX' WHEN v < 1 THEN 'LOW' WHEN v > 4 THEN 'HIGH' ELSE 'NORMAL' END
        WHEN v > 50 THEN 'INVALID_MAX' WHEN v < 3 THEN 'CRITICAL_LOW' WHEN v > 48 THEN 'CRITICAL_HIGH' WHEN v < 10 THEN 'LOW' WHEN v > 40 THEN 'HIGH' ELSE 'NORMAL' END AS status FROM r
""")
def printed_unit_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses by the rule for the printed unit, by name or symbol in any spelling, else for the test's default unit; some numbers have commas."""
    k = F.col("l_linenumber")
    unit = F.when(k % 4 == 0, " DZ").when(k % 2 == 0, "Do zen").when(k == 1, "").otherwise("other")
    rows = _results(spark, sf_dir).withColumns({"unit": unit, "value": F.when(k % 5 == 0, F.concat(F.lit("1,00"), "value")).otherwise(F.col("value"))})
    units, _, _, rules = _tables(spark)
    defaults = spark.createDataFrame([("N", "each"), ("R", "each")], "test string, unit string")
    return catalog.rules_by_printed_unit(rows, rules, defaults, units=units).select("l_orderkey", "l_linenumber", "status")


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS test, l_linenumber % 3 AS k, CAST(l_quantity AS INT) AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN test = 'N' AND k = 1 THEN CAST(CAST(v AS DECIMAL(10, 0)) * CAST('0.08333333' AS DECIMAL(15, 8)) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS new_value,
           CASE WHEN test = 'N' AND k = 1 THEN 'dz' ELSE CASE k WHEN 0 THEN 'ea' WHEN 1 THEN 'each' ELSE 'dz' END END AS new_unit, CASE WHEN test = 'N' AND k = 1 THEN NULL ELSE 'no conversion' END AS problem FROM r
""")
def converted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in dozens where an active conversion leads there: the exact product, in the unit as asked for."""
    units, conversions, _, _ = _tables(spark)
    return catalog.convert_results(_results(spark, sf_dir).withColumn("to_unit", F.lit("dz")), units, conversions).select("l_orderkey", "l_linenumber", "new_value", "new_unit", "problem")


@query("""
    WITH u AS (SELECT s_nationkey AS test, CAST(s_suppkey % 7 AS VARCHAR) AS unit, bool_or(s_acctbal > 0) AS active FROM supplier GROUP BY ALL),
    c AS (SELECT DISTINCT c_nationkey AS test, CAST(c_custkey % 7 AS VARCHAR) AS a, CAST(c_custkey % 5 AS VARCHAR) AS b FROM customer)
    SELECT test, a AS from_unit, b AS to_unit FROM c WHERE EXISTS (SELECT 1 FROM u WHERE u.test = c.test AND u.unit = a AND active) AND EXISTS (SELECT 1 FROM u WHERE u.test = c.test AND u.unit = b AND active)
""")
def available_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    type_units = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("test"), (F.col("s_suppkey") % 7).cast("string").alias("unit")).agg(F.bool_or(F.col("s_acctbal") > 0).alias("is_active"))
    conversions = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("test"), (F.col("c_custkey") % 7).cast("string").alias("from_unit"), (F.col("c_custkey") % 5).cast("string").alias("to_unit"), F.lit(True).alias("is_active")).distinct()
    return catalog.conversions_among(conversions, type_units).select("test", "from_unit", "to_unit")


def _nation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of nations, as of tests: by supplier; active where one of the suppliers has a positive balance."""
    return read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("test"), (F.col("s_suppkey") % 7).cast("string").alias("unit")).agg(F.bool_or(F.col("s_acctbal") > 0).alias("is_active"))


@query("""
    WITH u AS (SELECT s_nationkey AS test, CAST(s_suppkey % 7 AS VARCHAR) AS name FROM supplier GROUP BY ALL HAVING bool_or(s_acctbal > 0))
    SELECT test, name, 'u' || name AS symbol FROM u WHERE name IN (SELECT CAST(p_size % 6 AS VARCHAR) FROM part)
""")
def supported_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active units of each nation, with their symbols."""
    units = read(spark, sf_dir, "part").select((F.col("p_size") % 6).cast("string").alias("name")).distinct().withColumn("symbol", F.concat(F.lit("u"), "name"))
    return catalog.supported_units(_nation_units(spark, sf_dir), units)


@query("""
    WITH c AS (SELECT c_nationkey AS test, c_custkey % 7 AS a, c_custkey % 5 AS b, max(1 + c_custkey % 3) AS f, max(2 + c_custkey % 4) AS r FROM customer WHERE c_custkey % 7 <> c_custkey % 5 GROUP BY ALL),
    d AS (SELECT n_nationkey AS test, n_nationkey + 1 AS low, 10 * (n_nationkey + 1) AS high FROM nation),
    x AS (SELECT test, b AS unit, f AS factor, 0 AS back FROM c WHERE a = 0 UNION ALL SELECT test, a, r, 1 FROM c WHERE b = 0),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY test, unit ORDER BY back) = 1)
    SELECT test, CAST(unit AS VARCHAR) AS unit, CAST(low * factor AS DOUBLE) AS normal_min, CAST(high * factor AS DOUBLE) AS normal_max FROM y JOIN d USING (test)
""")
def derived_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of nations' further units from that of unit 0: one row for each, however many conversions there are."""
    key = F.col("c_custkey")
    conversions = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("test"), (key % 7).cast("string").alias("from_unit"), (key % 5).cast("string").alias("to_unit")).agg(F.max(1 + key % 3).cast("decimal(15,8)").alias("conversion_factor"), F.max(2 + key % 4).cast("decimal(15,8)").alias("reverse_factor"))
    conversions = conversions.where("from_unit <> to_unit").withColumn("is_active", F.lit(True))
    low = F.col("n_nationkey") + 1
    defaults = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("test"), F.lit("0").alias("unit"), low.cast("decimal(10,4)").alias("normal_min"), (10 * low).cast("decimal(10,4)").alias("normal_max"))
    found = catalog.derived_ranges(conversions, defaults).drop("conversion_factor")
    return found.withColumns({c: F.col(c).cast("double") for c in ("normal_min", "normal_max")})


@query("""
    WITH u AS (SELECT s_nationkey AS test, CAST(s_suppkey % 7 AS VARCHAR) AS unit FROM supplier GROUP BY ALL HAVING bool_or(s_acctbal > 0))
    SELECT DISTINCT c_nationkey AS test, CAST(c_custkey % 7 AS VARCHAR) AS unit, EXISTS (SELECT 1 FROM u WHERE u.test = c_nationkey AND u.unit = CAST(c_custkey % 7 AS VARCHAR)) AS is_active FROM customer
""")
def deactivated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each unit of a nation's customers; those of units that no supplier of the nation has any more are switched off."""
    rules = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("test"), (F.col("c_custkey") % 7).cast("string").alias("unit"), F.lit(True).alias("is_active")).distinct()
    return catalog.deactivate_rules(rules, _nation_units(spark, sf_dir))


@query("""
    SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'own' END, (SELECT min(q.p_brand) FROM part q WHERE q.p_name = part.p_name AND q.p_partkey % 2 = 0)) AS test FROM part
""")
def backfilled_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing tests from the names of other parts, in other case and spacing."""
    part = read(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.concat(F.lit("  "), F.upper("p_name")).alias("printed"), F.when(F.col("p_partkey") % 3 == 0, "own").alias("test"))
    return catalog.backfill_tests(rows, part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), F.col("p_brand").alias("key")), name="printed", test="test").select("p_partkey", "test")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cascaded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "customer").where("c_nationkey = 3")
    return records.cascade(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, key="c_custkey", parent="o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN o_custkey END AS o_custkey FROM orders")
def orphaned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "customer").where("c_nationkey = 3")
    return records.cascade(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, key="c_custkey", parent="o_custkey", keep=True)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS state, o_orderkey % 2 = 0 AND o_orderstatus = 'O' AS moved FROM orders")
def moved_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    return records.change_states(rows, rows.where("id % 2 = 0").select("id", F.lit("O").alias("old"), F.lit("F").alias("new")))


@query("SELECT o_custkey, min(o_orderkey) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey UNION ALL SELECT o_custkey, -count(*) FROM orders WHERE o_custkey % 2 = 1 GROUP BY o_custkey")
def appended_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of even customers, to which odd ones are added and even ones aren't again."""
    orders = read(spark, sf_dir, "orders")
    history = orders.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("n"))
    return records.append_history(history, orders.groupBy("o_custkey").agg((-F.count("*")).alias("n")), keys=["o_custkey"])


@query("""
    SELECT c_custkey, coalesce((SELECT CAST(to_json(list(struct_pack(o_orderkey := o_orderkey, o_orderstatus := o_orderstatus) ORDER BY o_orderkey)) AS VARCHAR) FROM orders WHERE o_custkey = c_custkey), '[]') AS orders FROM customer
""")
def exported_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with all orders as JSON."""
    told = records.nested(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders"), key="c_custkey", of="o_custkey", columns=["o_orderkey", "o_orderstatus"], name="orders")
    return told.withColumn("orders", F.to_json("orders"))


@query("SELECT event_id FROM events WHERE value IS DISTINCT FROM 0 AND event_type <> 'view' AND starts_with(event_type, 'p') OR user_id % 5 = 0 AND value IS NULL")
def filtered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, exclusion that keeps nulls, and a null or composite condition."""
    kept = records.not_equal("value", 0.0) & records.not_equal("event_type", "view") & F.startswith("event_type", F.lit("p"))
    return read(spark, sf_dir, "events").where(kept | ((F.col("user_id") % 5 == 0) & F.col("value").isNull())).select("event_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ed') OR contains(lower(p_brand), 'ed')")
def alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(catalog.aliases_contain(F.array("p_name", F.upper("p_brand")), "ED")).select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type <> 'error' OR value IS NULL OR value > 0.5")
def confident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stand for rows of unknown status, values for confidences."""
    rows = read(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "error", "Unknown").otherwise("NORMAL"))
    return records.without_noise(rows, status="status", confidence="value").select("event_id")


@query("""
    SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) > 1 OR (o_orderstatus = 'F' AND l_returnflag IN ('R', 'N')) OR (o_orderstatus = 'P' AND l_returnflag IN ('N', 'A')) AS covered
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
""")
def covered_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tests that an order has by link or by name, or that an earlier line adds.

    Finished orders have R under another name and an unlinked N, pending ones a linked row of name A.
    """
    adds = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("test"), F.col("l_returnflag").alias("name"))
    known = spark.createDataFrame([("F", "R", "x"), ("F", None, " n"), ("P", "N", "a")], "o_orderstatus string, test string, name string")
    rows = read(spark, sf_dir, "orders").join(F.broadcast(known), "o_orderstatus").select(F.col("o_orderkey").alias("l_orderkey"), "test", "name")
    return records.covered(adds, rows, group="l_orderkey", test="test", name="name", order="l_linenumber").select("l_orderkey", "l_linenumber", "covered")


@query("SELECT event_type, count(*) AS n, round(coalesce(avg(value), 0), 6) AS mean_confidence, count_if(value > 0.7) AS n_sure FROM events GROUP BY event_type")
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.confidence_summary(read(spark, sf_dir, "events"), by=["event_type"], confidence="value").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""
    WITH c AS (SELECT l_orderkey, count(*) AS e, count_if(l_quantity > 10) AS m, count_if(l_quantity > 20) AS v FROM lineitem GROUP BY l_orderkey)
    SELECT CASE WHEN m = 0 THEN 'MISS_ALL' WHEN m * 100.0 / e >= 80 AND v * 100.0 / m >= 70 THEN 'OK' WHEN m * 100.0 / e >= 40 THEN 'PARTIAL' ELSE 'WEAK' END AS flag, count(*) AS n FROM c GROUP BY flag
""")
def scores_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of orders whose lines beyond 10 count as matched and beyond 20 as right."""
    counts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("expected"), F.count("*").alias("parsed"), F.count_if(F.col("l_quantity") > 10).alias("matched"), F.count_if(F.col("l_quantity") > 20).alias("value_ok"))
    return scoring.summary_by_flag(scoring.report_scores(counts))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 800 THEN '[Earlier text is left out]' || chr(10) || right(text, 800) ELSE text END) AS tail FROM documents WHERE text IS NOT NULL")
def text_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(F.encode(records.text_tail("text", 800), "UTF-8"), 256).alias("tail"))


@query("""
    WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
    SELECT doc_id, 0 AS part, line_no, line_no >= 20 AND line_no < 30 AS inside FROM l WHERE line_no >= 5 AND line_no < 45
""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 20 to 29 of each document, with 15 around them."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1)).alias("line_no"))
    parts = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("part"), F.lit(20).alias("first"), F.lit(30).alias("beyond"))
    return records.context_windows(parts, lines, doc="doc_id")


@query("""
    SELECT o_orderkey, coalesce((o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 24 HOUR) OR (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 1 HOUR), false) AS expired FROM orders
""")
def expired_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "running")
    return read(spark, sf_dir, "orders").select("o_orderkey", records.expired(status, "o_orderdate", "o_orderdate", F.to_timestamp(F.lit("1998-01-01 00:00:00"))).alias("expired"))


@query("""
    SELECT o_custkey, array_to_string(list_slice(k, greatest(len(k) - 2, 1), len(k)), ',') AS kept FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) || [-1] AS k FROM orders GROUP BY o_custkey)
""")
def dismissed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three dismissed keys of each customer; a repeated key doesn't count again."""
    lists = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("old"))
    new = F.array(F.element_at("old", 1), F.lit(-1).cast("long"))
    return lists.select("o_custkey", F.array_join(records.dismissed_keys("old", new, 3), ",").alias("kept"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS safe FROM orders")
def safe_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("o_orderkey") % 3 == 0, "update").otherwise("add")
    changes = F.create_map(F.lit("unit"), F.lit("x"), F.when(F.col("o_orderkey") % 2 == 0, "status").otherwise("value"), F.lit("y"))
    return read(spark, sf_dir, "orders").select("o_orderkey", records.safe_fix(action, changes).alias("safe"))


@query("SELECT o_custkey, o_orderkey % 3 AS run, o_orderkey FROM orders WHERE o_orderkey % 3 = o_custkey % 3 AND o_orderkey % 5 <> 0")
def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's current run, without what was dismissed."""
    found = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("run"), "o_orderkey")
    runs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 3).alias("current_run"))
    return records.finish_run(found, runs, found.where("o_orderkey % 5 = 0"), report="o_custkey", run="run", key="o_orderkey")


@query("""
    SELECT o_custkey, string_agg(o_orderkey || ' | ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey
""")
def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("blank", F.lit(" "))
    return records.table_text(orders, by=["o_custkey"], order=["o_orderkey"], columns=["o_orderkey", "blank", "o_orderpriority"])


@query("SELECT l_partkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 'value' ELSE 'indexed' END AS scale FROM lineitem GROUP BY l_partkey")
def series_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.one_unit(read(spark, sf_dir, "lineitem"), by=["l_partkey"], unit=F.col("l_returnflag"))


@query(r"""
    SELECT doc_id, length(trim(coalesce(text, ''), chr(10) || chr(9) || chr(13) || ' ')) AS n_chars, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[A-Za-z]{2,}.*\d'))) AS n_actionable FROM documents
""")
def actionable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.actionable_lines(read(spark, sf_dir, "documents"), id="doc_id", text="text")


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Patient Name : [REDACTED] Age : ' || (c_custkey % 90) ELSE 'Seen by Mrs. [REDACTED] 12' END AS line FROM customer
""")
def redacted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names after labels and titles in lines made from customers."""
    key = F.col("c_custkey")
    name = F.translate(F.concat(F.lit("Ann X"), (key % 1000).cast("string")), "0123456789", "abcdefghij")
    labelled = F.concat(F.lit("Patient Name : Dr. "), name, F.lit(" Age : "), (key % 90).cast("string"))
    line = F.when(key % 2 == 0, F.replace(labelled, F.lit("Dr. "), F.lit(""))).otherwise(F.concat(F.lit("Seen by Mrs. "), name, F.lit(" 12")))
    return read(spark, sf_dir, "customer").select("c_custkey", redact_names(line).alias("line"))


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 3 AND o_orderkey % 30 > 23 THEN NULL
           WHEN o_orderkey % 4 = 3 THEN ' ' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':05' ELSE ' ' || lpad(CAST(o_orderkey % 12 + CASE WHEN o_orderkey % 4 = 2 THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || ':30' END AS at
    FROM orders
""")
def typed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with times as people type them, some of which aren't real."""
    key = F.col("o_orderkey")
    hour = F.when(key % 12 == 0, 12).otherwise(key % 12).cast("string")
    time = F.when(key % 4 == 0, "").when(key % 4 == 3, F.concat(F.lit(" "), (key % 30).cast("string"), F.lit(":05"))).otherwise(F.concat(F.lit("  "), hour, F.when(key % 4 == 2, ":30PM").otherwise(":30 am")))
    typed = F.concat(F.date_format("o_orderdate", "d MMM yyyy"), time)
    return read(spark, sf_dir, "orders").select("o_orderkey", date_time_text(typed).alias("at"))


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'creatinine' WHEN 1 THEN 'alc_neutrophils' WHEN 2 THEN 'monocytes' ELSE 'protein' END AS test, CASE l_returnflag WHEN 'A' THEN 'dlc' WHEN 'N' THEN 'urine' END AS section, l_quantity AS q FROM lineitem),
    c AS (SELECT *, CASE WHEN section = 'dlc' AND test = 'alc_neutrophils' THEN 'dlc_neutrophils' WHEN section = 'urine' AND test = 'creatinine' THEN 'urine_creatinine' ELSE test END AS named FROM r)
    SELECT l_orderkey, l_linenumber, CASE WHEN named = 'creatinine' AND q > 10 THEN 'urine_creatinine' WHEN named = 'urine_creatinine' AND q < 392.0 / 20 THEN 'creatinine' ELSE named END AS test FROM c
""")
def tests_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by section, then serum or urine by the value; the catalog has some of the tests alone."""
    n = F.col("l_linenumber") % 4
    test = F.when(n == 0, "creatinine").when(n == 1, "alc_neutrophils").when(n == 2, "monocytes").otherwise("protein")
    section = F.when(F.col("l_returnflag") == "A", "dlc").when(F.col("l_returnflag") == "N", "urine")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", test.alias("test"), section.alias("section"), F.col("l_quantity").cast("string").alias("value"), F.lit("1 - 15").alias("printed"))
    tests = spark.createDataFrame([("creatinine",), ("urine_creatinine",), ("dlc_neutrophils",), ("monocytes",), ("protein",)], "name string")
    rules = spark.createDataFrame([("creatinine", 2.0), ("urine_creatinine", 0.0)], "name string, normal_max double")
    named = context.tests_in_context(rows, tests, test="test", context="section")
    return context.serum_or_urine(named, tests, rules, test="test", value="value", printed="printed").select("l_orderkey", "l_linenumber", "test")


@query("""
    WITH c AS (SELECT conv_id, turn, conv_id % 2 = 0 AS inline_, turn % 3 = 1 AS thinks, turn % 3 <> 1 AS talks FROM conversations),
    f AS (SELECT *, talks AND inline_ AND turn <= 3 AS inside FROM c),
    n AS (SELECT conv_id, turn, sum(CAST(thinks OR inside AS INT)) OVER w AS reasoning_tokens, sum(CAST(talks AND NOT inside AS INT)) OVER w AS reply_tokens FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CAST(reasoning_tokens AS BIGINT) AS reasoning_tokens, CAST(reply_tokens AS BIGINT) AS reply_tokens, CASE WHEN reply_tokens > 0 THEN 'writing' ELSE 'thinking' END AS phase FROM n
""")
def reply_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of replies; every other reply thinks inline, and its closing tag is split over turns 2 and 3."""
    turn = F.col("turn")
    inline = F.when(turn == 0, " <think>a").when(turn == 2, "b</thi").when(turn == 3, "nk>c").otherwise("d")
    content = F.when(turn % 3 != 1, F.when(F.col("conv_id") % 2 == 0, inline).otherwise("e"))
    chunks = read(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("content"), F.when(turn % 3 == 1, "f").alias("reasoning"))
    return context.reply_phases(chunks, reply=["conv_id"], order=["turn"], content="content", reasoning="reasoning").drop("content", "reasoning")


@query("""
    WITH a AS (SELECT p_name, min(p_brand) AS unit, list_sort(list(DISTINCT p_type)) AS kinds FROM part GROUP BY p_name)
    SELECT replace(p_name, ' ', '_') AS name, replace(p_name, ' ', '_') || ': ' || p_name || ' [' || CASE WHEN unit LIKE '%1' THEN lower(unit) ELSE unit END || '] (' || array_to_string(kinds[1:3], ', ') || ')' AS line FROM a
""")
def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each name of parts, with its least brand as the unit and its first three types as aliases; brands that end in 1 have a symbol."""
    part = read(spark, sf_dir, "part")
    named = part.groupBy("p_name").agg(F.min("p_brand").alias("default_unit"), F.sort_array(F.collect_set("p_type")).alias("aliases"))
    tests = named.select(F.translate("p_name", " ", "_").alias("name"), F.col("p_name").alias("display_name"), "default_unit", "aliases")
    units = part.where(F.col("p_brand").endswith("1")).select(F.col("p_brand").alias("name"), F.lower("p_brand").alias("symbol")).distinct()
    return records.catalog_lines(tests, units, most=3)


@query("""
    SELECT DISTINCT user_id AS code, c_custkey IS NOT NULL AS known, c_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS empty
    FROM events LEFT JOIN customer ON c_custkey = user_id
""")
def chosen_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that events name: those that aren't known, and those without orders."""
    wanted, known = read(spark, sf_dir, "events").select(F.col("user_id").alias("code")), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    return records.chosen_reports(wanted, known, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code")), code="code")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'N' AND l_linenumber * 10 BETWEEN l_orderkey % 3 * 10 AND l_orderkey % 3 * 10 + 29 AS seen FROM lineitem
""")
def seen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items printed on every tenth line, but for new ones, and which of them lie in the thirty lines shown of their order."""
    at, first = F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") * 10), F.col("l_orderkey") % 3 * 10
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", records.row_seen(at, first, first + 30).alias("seen"))


@query("""
    SELECT user_id, CAST(CAST(ts + CASE user_id % 3 WHEN 0 THEN INTERVAL 330 MINUTE WHEN 1 THEN INTERVAL 540 MINUTE ELSE INTERVAL (-420) MINUTE END AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL
""")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by their user's day, in zones without summer time."""
    zone = F.when(F.col("user_id") % 3 == 0, "Asia/Kolkata").when(F.col("user_id") % 3 == 1, "Asia/Tokyo").otherwise("America/Phoenix")
    return read(spark, sf_dir, "events").groupBy("user_id", local_day("ts", zone).cast("string").alias("day")).agg(F.count("*").alias("n"))

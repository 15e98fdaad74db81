"""Tables, rows over several lines and two readers over the demonstration tables: orders as recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import recognised, report_text, row_grammars
from tarnwork.plans._read import read
from tarnwork.plans.analytics import query
from tarnwork.session import materialize


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with what stands for a result: name, value, unit, range and flag."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", F.concat("p_name", F.lit(" (S)")).alias("name"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5")).alias("value"), F.lit("<40").alias("ref"), F.when(F.col("l_quantity") >= 40, "H").otherwise("within  range").alias("flag")).alias("x"))


def _text(rows: Column, line, sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(rows), line), sep)


@query("""
    WITH l AS (SELECT l_orderkey, l_orderkey % 5 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n, p_name || ' (S)' AS name, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5' AS value, l_quantity >= 40 AS high FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, CAST(CASE WHEN k IN (1, 3) THEN n - 1 ELSE n END AS INT) AS row_no, name, value, CASE WHEN k IN (0, 2, 4) THEN 'mg/dL' ELSE '' END AS unit, '<40' AS reference_range, CASE WHEN k IN (0, 2) THEN CASE WHEN high THEN 'HIGH' ELSE 'NORMAL' END ELSE 'UNKNOWN' END AS status FROM l
""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a table: in HTML or Markdown or by tabs, with its columns told by a header in some order, or by their number alone."""
    k = F.col("l_orderkey") % 5
    html = lambda *cells: F.concat(F.lit("<tr>"), *[p for c in cells for p in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>"))
    page = lambda head, body: F.concat(F.lit(f"<html><table></table><TABLE class='x'>{head}"), body, F.lit("</TABLE><table><tr><td>no</td></tr></table>"))
    rows = F.collect_list("x")
    mixed = page("<tr><th>Flag</th><th>Bio. Ref. Interval</th><th>Unit &amp; more</th><th>Observed value</th><th>Test <b>name</b></th></tr>", _text(rows, lambda x: html(x["flag"], F.replace(x["ref"], F.lit("<"), F.lit("&lt;")), F.lit("mg/dL"), x["value"], F.concat(F.lit("<i>"), x["name"], F.lit("</i>"))), ""))
    bare = page("", _text(rows, lambda x: html(x["name"], x["value"], F.replace(x["ref"], F.lit("<"), F.lit("&lt;"))), ""))
    bars = F.concat(F.lit("Here it is:\n| Investigation | Result | Units | Normal range | Remark |\n|:--|---|---|--:|---|\n"), _text(rows, lambda x: F.concat(F.lit("| "), x["name"], F.lit(" | "), x["value"], F.lit(" | mg/dL | "), x["ref"], F.lit(" | "), x["flag"], F.lit(" |"))))
    tabs = _text(rows, lambda x: F.concat_ws("\t", x["name"], x["value"], x["ref"]))
    spaces = F.concat(F.lit("Parameter  Reading  UoM  Reference\n# comment\n"), _text(rows, lambda x: F.concat_ws("   ", x["name"], x["value"], F.lit("mg/dL"), x["ref"])))
    docs = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.when(k == 0, mixed).when(k == 1, bare).when(k == 2, bars).when(k == 3, tabs).otherwise(spaces).alias("text"))
    return recognised.read_tables(docs, id="l_orderkey", text="text")


@query("""
    WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n, l_partkey % 4 AS k, p_name || ' (S)' AS name, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5' AS value FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, name, value, CASE WHEN k IN (1, 3) THEN 'mL/min/1.73 m2' ELSE '' END AS unit, CASE WHEN k >= 2 THEN '<40' ELSE '' END AS reference_range, count(*) AS n FROM l GROUP BY ALL
""")
def grouped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's results over two to four lines, with remarks, headings and blank lines between them."""
    k = lambda x: x["l_partkey"] % 4
    parts = lambda x: F.array_compact(F.array(F.lit("LIPID PANEL"), F.lit("  "), x["name"], F.concat(F.lit(" \\( "), x["value"], F.lit(" \\) ")), F.when(k(x) % 2 == 1, "mL/min/1.73  m²"), F.when(k(x) >= 2, x["ref"]), F.lit("(method)"), F.lit("Mr. Roe")))
    docs = _lines(spark, sf_dir).groupBy("l_orderkey").agg(_text(F.collect_list("x"), lambda x: F.array_join(parts(x), "\n")).alias("text"))
    return recognised.read_line_groups(docs, id="l_orderkey", text="text").groupBy("l_orderkey", "name", "value", "unit", "reference_range").agg(F.count("*").alias("n"))


@query("""
    WITH l AS (SELECT l_orderkey, l_orderkey % 3 AS k, p_name, CAST(l_quantity AS INT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
    o AS (SELECT l_orderkey, k, count(DISTINCT (p_name, q)) AS n, count(*) AS lines FROM l GROUP BY ALL)
    SELECT l_orderkey, CASE WHEN k = 0 THEN n ELSE 0 END AS n_rows, CASE WHEN k = 0 THEN lines ELSE 0 END AS n_lines, k = 0 AND n >= 3 AND NOT (lines >= 8 AND n < lines * 0.5) AS sufficient, CASE WHEN k = 0 THEN 0 ELSE n END AS n_added, CASE WHEN k = 0 THEN 'first' ELSE 'second' END AS reader FROM o
""")
def two_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plain lines, as rows over several lines, or as tables: the grammars read them, and the second reader those they didn't read well."""
    k, rows = F.col("l_orderkey") % 3, F.collect_list("x")
    plain = _text(rows, lambda x: F.concat_ws(" ", x["name"], x["value"], F.lit("mg/dL"), x["ref"]))
    groups = _text(rows, lambda x: F.concat_ws("\n", x["name"], x["value"], F.lit("mg/dL"), x["ref"]))
    table = F.concat(F.lit("<table>"), _text(rows, lambda x: F.concat(F.lit("<tr><td>"), x["name"], F.lit("</td><td>"), x["value"], F.lit("</td></tr>")), ""), F.lit("</table>"))
    # Written once, as both readers and the first one's quality are all made of it.
    docs = materialize(_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.when(k == 0, plain).when(k == 1, groups).otherwise(table).alias("text")), "two-readers")
    columns = ("name", "value", "unit", "reference_range", "status")
    lines = report_text.explode_lines(docs, id="l_orderkey", text="text")
    read_lines = row_grammars.parse_repeated_rows(lines, line="line", longest=recognised.LONG_LINE).withColumn("section", F.lit(None).cast("string"))
    first = report_text.distinct_rows(read_lines, doc=["l_orderkey"], order=["line_no"]).withColumnRenamed("raw_name", "name").select("l_orderkey", *columns)
    second = lambda some: recognised.read_recognised(some, id="l_orderkey", text="text").select("l_orderkey", *columns)
    return recognised.hybrid_rows(docs, first, second, id="l_orderkey", text="text", keys=[F.lower("name"), F.col("value")])[1]


@query("""
    WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS n, p_name, CAST(l_quantity AS INT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey * 100 + n AS row_id, CAST(CASE WHEN l_orderkey % 4 = 0 THEN n ELSE (SELECT min(x.n) FROM l x WHERE x.l_orderkey = l.l_orderkey AND x.q = l.q AND contains(x.p_name, regexp_extract(l.p_name, '[a-z]{3,}'))) END AS INT) AS line_no FROM l
""")
def located_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order's results are printed in its text; for every fourth order a reader has recorded it."""
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # Written once, as rows, lines and records are all made of it.
    docs = materialize(rows.select("l_orderkey", F.posexplode("xs").alias("line_no", "x")).select("l_orderkey", "line_no", F.struct("x.name", "x.value").alias("x")), "located-lines")
    lines = docs.select("l_orderkey", "line_no", F.concat_ws(" ", F.upper("x.name"), "x.value", F.lit("mg/dL 1"), F.concat(F.lit("0"), "x.value")).alias("line"))
    asked = docs.select("l_orderkey", (F.col("l_orderkey") * 100 + F.col("line_no")).alias("row_id"), "x.name", "x.value", "line_no")
    recorded = asked.where("l_orderkey % 4 = 0").select("row_id", "line_no")
    return report_text.locate_rows(asked.drop("line_no"), lines, doc="l_orderkey", id="row_id", name="name", value="value", recorded=recorded).select("row_id", "line_no")

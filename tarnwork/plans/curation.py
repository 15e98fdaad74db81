"""Merging, text lines, tables, resolution, scoring and suggestions over the demonstration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.text import redact_contacts
from tarnwork.operators import merging, report_text, resolve, row_grammars, scoring, suggestions, tables
from tarnwork.plans._read import read
from tarnwork.plans.analytics import query


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return merging.first_occurrence(rows, keys=["o_custkey", "o_orderstatus"], order=["o_orderkey"])


@query("""
    SELECT doc_id, source, nullif(min(doc_id) OVER (PARTITION BY source, text), doc_id) AS duplicate_of FROM documents
""")
def earliest_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    return merging.earliest_duplicate(docs, tenant=["source"], content=F.col("sha"), order=["doc_id"], id="doc_id").drop("sha")


@query("""
    WITH b AS (SELECT c_nationkey AS nation, c_custkey % 10 AS k, 0 AS source, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, s_suppkey % 10, 1, s_suppkey FROM supplier)
    SELECT nation, k, source, id FROM b QUALIFY row_number() OVER (PARTITION BY nation, k ORDER BY source, id) = 1
""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 10).alias("k"), F.col("c_custkey").alias("id"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 10).alias("k"), F.col("s_suppkey").alias("id"))
    return merging.merge_sources([customers, suppliers], keys=["nation", "k"], order=["id"])


@query("""
    WITH b AS (SELECT c_nationkey AS nation, 0 AS source, c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier),
    n AS (SELECT nation, source, count(*) AS n FROM b GROUP BY ALL), best AS (SELECT nation, source FROM n QUALIFY row_number() OVER (PARTITION BY nation ORDER BY n DESC, source) = 1)
    SELECT b.* FROM b JOIN best USING (nation, source)
""")
def larger_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return merging.larger_source([customers, suppliers], keys=["nation"])


@query("""
    SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_size < 40 THEN 'new' ELSE p_name END AS name, p_size >= 40 AS edited FROM part
""")
def protected_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names for every third part, except where an edited row is protected."""
    current = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") >= 40).alias("edited"))
    new = current.where("id % 3 = 0").select("id", F.lit("new").alias("name"), "edited")
    return merging.upsert(current, new, keys=["id"], protected="edited")


@query("""
    SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'user' ELSE 'built-in' END AS source, p_partkey % 5 <> 0 AS is_active FROM part WHERE NOT (p_partkey % 5 = 0 AND p_size % 2 = 0)
""")
def removed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "user").otherwise("built-in").alias("source"), F.lit(True).alias("is_active"))
    return merging.remove_rows(current, current.where("id % 5 = 0").select("id"), keys=["id"])


@query("""
    WITH r AS (SELECT o_orderkey AS row_id, o_custkey AS k, CAST(o_orderdate AS DATE) AS day, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS n FROM orders)
    SELECT row_id, CASE WHEN row_id % 2 = 0 THEN row_id WHEN n = 1 THEN row_id END AS matched_id FROM r
""")
def unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have lost every other id, matched again by key where that is unique."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    left = rows.select("row_id", F.when(F.col("row_id") % 2 == 0, F.col("row_id")).alias("known"), "k", "day")
    found = merging.unique_match(left.withColumnRenamed("row_id", "own").withColumnRenamed("known", "row_id"), rows, id="row_id", keys=["k", "day"])
    return found.select(F.col("own").alias("row_id"), "matched_id")


@query("""
    WITH t AS (SELECT user_id, event_id, CASE WHEN event_type IN ('signup', 'view') THEN event_type WHEN event_type = 'error' THEN '__END__' END AS tag, ts FROM events)
    SELECT user_id, event_id, nullif(last_value(tag IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '__END__') AS section FROM t
""")
def carried_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    found = report_text.carry_section(read(spark, sf_dir, "events"), partition=["user_id"], order=["ts", "event_id"], header=F.when(kind.isin("signup", "view"), kind), ends=kind == "error")
    return found.select("user_id", "event_id", "section")


@query("""
    SELECT user_id, event_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS after_error FROM events
""")
def block_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report_text.flag_from(read(spark, sf_dir, "events"), partition=["user_id"], order=["ts", "event_id"], starts=F.col("event_type") == "error", name="after_error")
    return found.select("user_id", "event_id", "after_error")


@query("""
    WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, len(string_split(text, chr(10))) AS n FROM documents),
    long AS (SELECT source, line FROM l WHERE length(line) >= 20 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2),
    top AS (SELECT source, line FROM l WHERE pos <= 12 GROUP BY source, line, pos HAVING count(DISTINCT doc_id) >= 2),
    bottom AS (SELECT source, line FROM l WHERE n - pos + 1 <= 6 GROUP BY source, line, n - pos + 1 HAVING count(DISTINCT doc_id) >= 2)
    SELECT source, md5(line) AS line_md5 FROM (SELECT * FROM long UNION SELECT * FROM top UNION SELECT * FROM bottom)
""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand on two or more of a source's documents, as on a report's pages."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return report_text.repeated_lines(lines, doc=["source"], page="doc_id", pos="pos", line="line").select("source", F.md5("line").alias("line_md5"))


@query()
def prepared_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted lines without boilerplate and repeats; SQL engines lack the look-around of the phone patterns."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return report_text.prepare_text(lines, doc=["source"], page="doc_id", pos="pos", line="line")


@query("""
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\n]*@[^ \\n]*'), lambda x: regexp_replace(x, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+', '[REDACTED]', 'g')), ' ') AS mail FROM documents
""")
def redacted_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs around an ``@`` of each document, redacted."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \n]*@[^ \n]*"), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(runs, redact_contacts), " ").alias("mail"))


@query()
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text redacted line by line, as a digest, and the number of redactions; SQL engines lack the look-around."""
    marks = lambda text: F.regexp_count(text, F.lit(r"\[REDACTED\]"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select("doc_id", marks(F.col("text")).alias("before"), F.array_join(F.transform(F.split("text", "\n"), redact_contacts), "\n").alias("text"))
    return found.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), (marks(F.col("text")) - F.col("before")).alias("n_redacted"))


_LINES = {
    # Line, grammar, label, value, unit, printed range; {q} is a quantity.
    0: ("Part A level {q}.5 mg/dL 10 - 40", "tabular", "Part A level", "{q}.5", "mg/dL", "10 - 40"),
    1: ("Base Excess -{q}.5 mmol/L", "tabular", "Base Excess", "-{q}.5", "mmol/L", ""),
    2: ("Marker B <={q} mg/dL <20", "tabular", "Marker B", "<={q}", "mg/dL", "<20"),
    3: ("Hemoglobin (Hb) {q}.00 Normal 13.00 - 17.00 g/dL", "value_range_unit", "Hemoglobin (Hb)", "{q}.00", "g/dL", "13.00 - 17.00"),
    4: ("HBsAg Weak Positive Negative", "qualitative", "HBsAg", "Weak Positive", "", "Negative"),
    5: ("Colour Dark Brown Brown", "descriptive", "Colour", "Dark Brown", "", "Brown"),
    6: ("ABO Group AB", "categorical", "ABO Group", "AB", "", ""),
    7: ("Synthesis Factor {q} 0.30 - 0.70 *", "unitless", "Synthesis Factor", "{q}", "", "0.30 - 0.70 *"),
    8: ("pH {q}.0", "simple", "pH", "{q}.0", "", ""),
    9: ("Type of Sample Urine", "text_pair", "Type of Sample", "Urine", "", ""),
    10: ("Vitamin D 30 nmol/L {q} - 50 sufficient", "tabular", "Vitamin D", "30", "nmol/L", "{q} - 50 sufficient"),
    11: ("HbA1c {q}.1 % Non-diabetic: < 5.7", "tabular", "HbA1c", "{q}.1", "%", "Non-diabetic: < 5.7"),
    12: ("HIV Negative", "qualitative", "HIV", "Negative", "", ""),
    13: ("Page 1 of 2",),
    14: ("Levels of the disease {q}.0",),
    15: ("Visit ID {q}",),
}


def _case(field: int) -> str:
    """SQL that gives a field of ``_LINES`` by ``k``."""
    quoted = lambda t: "'" + t.replace("{q}", "' || q || '") + "'"
    return "CASE k " + " ".join(f"WHEN {k} THEN {quoted(x[field])}" for k, x in _LINES.items() if len(x) > field) + " END"


@query(f"""
    WITH l AS (SELECT l_orderkey, l_linenumber, (l_partkey + l_linenumber) % {len(_LINES)} AS k, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem),
    r AS (SELECT l_orderkey, l_linenumber, k, CAST(q AS INT) AS n, {_case(1)} AS grammar, {_case(2)} AS raw_name, {_case(3)} AS value, {_case(4)} AS unit, {_case(5)} AS reference_range FROM l)
    SELECT l_orderkey, l_linenumber, grammar, raw_name, value, unit, reference_range,
           CASE k WHEN 0 THEN CASE WHEN n + 0.5 < 10 THEN 'LOW' WHEN n + 0.5 > 40 THEN 'HIGH' ELSE 'NORMAL' END WHEN 2 THEN CASE WHEN n >= 20 THEN 'HIGH' ELSE 'NORMAL' END
                  WHEN 3 THEN CASE WHEN n < 13 THEN 'LOW' WHEN n > 17 THEN 'HIGH' ELSE 'NORMAL' END WHEN 7 THEN CASE WHEN n < 0.3 THEN 'LOW' WHEN n > 0.7 THEN 'HIGH' ELSE 'NORMAL' END
                  WHEN 10 THEN CASE WHEN 30 < n THEN 'LOW' WHEN 30 > 50 THEN 'HIGH' ELSE 'NORMAL' END WHEN 11 THEN CASE WHEN n + 0.1 >= 5.7 THEN 'HIGH' ELSE 'NORMAL' END WHEN 12 THEN 'NORMAL' ELSE 'UNKNOWN' END AS status,
           CASE WHEN grammar IN ('tabular', 'value_range_unit') THEN 0.7 ELSE 0.75 END AS confidence
    FROM r WHERE grammar IS NOT NULL
""")
def parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all kinds made from line items, noise among them, and read back by the grammars."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    made = F.create_map(*[F.lit(x) for k, line in _LINES.items() for x in (k, line[0])])[((F.col("l_partkey") + F.col("l_linenumber")) % len(_LINES)).cast("int")]
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.replace(made, F.lit("{q}"), quantity).alias("line"))
    return row_grammars.parse_repeated_rows(lines, line="line").drop("line", "pattern_test")


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, p_name, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5' AS value, l_quantity + 0.5 AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
    d AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, p_name, value ORDER BY l_linenumber, v) = 1)
    SELECT l_orderkey, p_name AS raw_name, value, CASE WHEN l_orderkey % 2 = 0 THEN 'urine' END AS section, CASE WHEN l_orderkey % 2 = 1 THEN replace(p_name, ' ', '_') END AS test,
           CASE WHEN l_orderkey % 2 = 1 THEN 'The ' || p_name ELSE p_name END AS display_name,
           CASE WHEN l_orderkey % 2 = 0 THEN 'UNKNOWN' WHEN v < 10 THEN 'LOW' WHEN v > 40 THEN 'HIGH' ELSE 'NORMAL' END AS status, CASE WHEN l_orderkey % 2 = 1 THEN 0.9 ELSE 0.7 END AS confidence
    FROM d
""")
def read_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a report: its lines read, resolved within their section, and judged by rules where no range is printed."""
    part = read(spark, sf_dir, "part")
    rows = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat("p_name", F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(".5 mg/dL"))
    heading = F.when(F.col("l_orderkey") % 2 == 0, "URINE EXAMINATION").otherwise("LIPID PROFILE :")
    text = F.concat_ws("\n", F.lit("Patient Name : Jane Roe"), heading, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n"), F.lit("*** End Of Report ***"))
    docs = rows.withColumn("line", line).groupBy("l_orderkey").agg(text.alias("text"))
    names = part.select("p_name").distinct()
    tests = names.select(F.translate("p_name", " ", "_").alias("name"), F.concat(F.lit("The "), "p_name").alias("display_name"), F.array().cast("array<string>").alias("aliases"))
    rules = tests.select(F.col("name").alias("test"), F.lit("mg/dl").alias("unit"), F.lit(10).alias("normal_min"), F.lit(40).alias("normal_max"), F.lit(True).alias("is_active"))
    found = report_text.parse_report(docs, id="l_orderkey", text="text", catalog=tests, rules=rules, defaults=rules.select("test", "unit"))
    return found.select("l_orderkey", "raw_name", "value", "section", "test", "display_name", "status", "confidence")


@query("""
    WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    SELECT event_id, event_type || ' code' AS raw_name, 'test_' || event_type AS test, CAST(k AS VARCHAR) AS value, CASE WHEN event_type = 'error' THEN 'pts' ELSE 'N/A' END AS unit,
           CASE WHEN event_type = 'error' THEN '3 - ' || CAST(user_id AS VARCHAR) ELSE '>' || CAST(user_id AS VARCHAR) END AS reference_range,
           CASE WHEN event_type = 'error' THEN CASE WHEN k < 3 THEN 'LOW' WHEN k > user_id THEN 'HIGH' ELSE 'NORMAL' END ELSE CASE WHEN k <= user_id THEN 'LOW' ELSE 'NORMAL' END END AS status,
           CASE WHEN event_type = 'error' THEN 0.8 ELSE 0.4 END AS confidence
    FROM e WHERE event_type <> 'view'
""")
def pattern_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no grammar fits, read by a table of patterns: one row for each kind of event but inactive ones."""
    events = read(spark, sf_dir, "events")
    rows = events.select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").alias("k"))
    limit = F.when(F.col("event_type") == "error", F.concat(F.lit("[3 - "), F.col("user_id").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[> "), F.col("user_id").cast("string"), F.lit("]")))
    lines = rows.select("event_id", F.concat(F.lit("Code: "), "event_type", F.lit(" code = "), "k", F.lit(" pts; "), limit, F.lit(" ::")).alias("line"))
    kinds = events.select("event_type").distinct()
    groups = F.when(F.col("event_type") == "error", F.concat(F.lit(r"(?P<the_name>"), "event_type", F.lit(r" code) = (?P<v>\d+) (PTS);"))).otherwise(F.concat(F.lit("("), "event_type", F.lit(r" code) = (\d+)")))
    is_error = F.col("event_type") == "error"
    patterns = kinds.select(
        F.concat(F.lit("test_"), "event_type").alias("test"), F.col("event_type").alias("pattern_name"), groups.alias("regex_pattern"), F.when(is_error, 5).otherwise(2).alias("priority"),
        F.lit(2).alias("value_group"), F.when(is_error, 3).alias("unit_group"), F.lit(None).cast("int").alias("range_group"), (F.col("event_type") != "view").alias("is_active"),
    )
    broken = patterns.limit(1).select(F.lit("a").alias("test"), F.lit("broken").alias("pattern_name"), F.lit("(").alias("regex_pattern"), F.lit(9).alias("priority"), "value_group", "unit_group", "range_group", F.lit(True).alias("is_active"))
    found = row_grammars.parse_rows(lines, line="line", patterns=patterns.union(broken)).where("grammar = 'pattern'")
    return found.select("event_id", "raw_name", F.col("pattern_test").alias("test"), "value", "unit", "reference_range", "status", F.round("confidence", 6).alias("confidence"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON between words and fences."""
    reply = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```"))
    return read(spark, sf_dir, "events").select("event_id", tables.json_in_text(reply, "struct<k: int>")["k"].alias("k"))


@query("SELECT page_id, regexp_matches(html, '(?i)<table') AS has_table FROM pages")
def pages_with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.col("html").rlike("(?i)<table").alias("has_table"))


@query()
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names resolved against the catalog of part types and names."""
    catalog = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("display_name")).agg(F.sort_array(F.collect_set("p_type")).alias("types"))
    catalog = catalog.select(F.translate("display_name", " ", "_").alias("name"), "display_name", F.array(F.concat_ws(" ", "display_name", F.lit("level"))).alias("aliases"))
    names = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit(", SERUM (Method)")).alias("printed"))
    return resolve.resolve_names(names, catalog, key=["p_partkey"])


@query("""
    WITH c AS (SELECT d.doc_id, d.source, count(l.doc_id) AS expected, 1 AS parsed, coalesce(max(l.quality), 0) AS matched, coalesce(max(l.quality * (1 - l.toxic)), 0) AS value_ok FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL),
    s AS (SELECT source, sum(expected) AS expected, sum(parsed) AS parsed, sum(matched) AS matched, sum(value_ok) AS value_ok FROM c GROUP BY source)
    SELECT source, CAST(expected AS BIGINT) AS expected, CAST(parsed AS BIGINT) AS parsed, CAST(matched AS BIGINT) AS matched, CAST(value_ok AS BIGINT) AS value_ok, round(matched / greatest(expected, 1) * 100, 6) AS recall,
           round(CASE WHEN parsed = 0 THEN 100 ELSE matched / parsed * 100 END, 6) AS precision, round(CASE WHEN matched = 0 THEN 100 ELSE value_ok / matched * 100 END, 6) AS value_accuracy FROM s
""")
def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-averaged scores by source, with labels in the place of expected rows."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    counts = docs.join(labels, "doc_id", "left").groupBy("doc_id", "source").agg(F.count("quality").alias("expected"), F.lit(1).cast("long").alias("parsed"), F.coalesce(F.max("quality"), F.lit(0)).cast("long").alias("matched"), F.coalesce(F.max(F.col("quality") * (1 - F.col("toxic"))), F.lit(0)).cast("long").alias("value_ok"))
    found = scoring.corpus_scores(counts, ["source"])
    return found.select("source", "expected", "parsed", "matched", "value_ok", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "value_accuracy")])


@query()
def assigned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy assignment of each order's part names to shuffled spellings of them."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    expected = rows.select("l_orderkey", F.col("l_linenumber").alias("no"), F.col("p_name").alias("name"), F.col("l_returnflag").alias("unit"))
    parsed = expected.select("l_orderkey", (8 - F.col("no")).alias("no"), F.concat(F.col("name"), F.lit(" x")).alias("name"), "unit").toDF("l_orderkey", "no", "name", "unit")
    return scoring.assign_rows(expected, parsed, report="l_orderkey")


@query()
def planned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines in parts of at most 2,000 characters."""
    lines = report_text.explode_lines(read(spark, sf_dir, "documents"), id="doc_id", text="text").select("doc_id", "line_no", F.length("line").alias("size"))
    return scoring.plan_parts(lines, doc="doc_id", order="line_no", size="size", budget=2000)


@query("""
    SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || ' new' ELSE o_orderpriority END AS value FROM orders WHERE o_orderkey % 11 <> 0
""")
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of updates and removals folded into the current rows."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("value"))
    updates = rows.where("row_id % 7 = 0").select(F.col("row_id").alias("suggestion_id"), "row_id", F.lit("update").alias("action"), F.concat("value", F.lit(" new")).alias("value"))
    removals = rows.where("row_id % 11 = 0").select((F.col("row_id") + 1_000_000_000).alias("suggestion_id"), "row_id", F.lit("remove").alias("action"), F.lit(None).cast("string").alias("value"))
    return suggestions.apply_changes(rows, suggestions.change_log(updates.unionByName(removals), rows))


@query("""
    SELECT o_orderkey AS report_id, o_orderkey % 4 <> 0 AND o_orderstatus = 'F' AS queued, CASE WHEN o_orderkey % 4 = 0 THEN 'not found' WHEN o_orderstatus <> 'F' THEN 'not ready' END AS reason FROM orders
""")
def queued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    reports = orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("report_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("PENDING").alias("status"))
    return suggestions.queue_jobs(orders.select(F.col("o_orderkey").alias("report_id")), reports)


@query("""
    SELECT o_orderkey AS report_id, o_orderkey % 4 <> 0 AND o_orderstatus = 'F' AS queued, CASE WHEN o_orderkey % 4 = 0 THEN 'not found' WHEN o_orderstatus <> 'F' THEN 'not ready' END AS reason FROM orders
""")
def queued_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of ``queued_jobs``: a job for each order."""
    orders = read(spark, sf_dir, "orders")
    reports = orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("report_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("PENDING").alias("status"))
    return suggestions.queue_jobs(orders.select(F.col("o_orderkey").alias("report_id")), reports)

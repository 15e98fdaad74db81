"""Lines read by keywords, and prescriptions, over the demonstration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import keyword_lines, prescriptions
from tarnwork.plans._read import read
from tarnwork.plans.analytics import query

_NAMED = " ".join(f"WHEN regexp_matches(line, '{words}', 'i') THEN '{name}'" for name, words in keyword_lines.KEYWORDS.items())


@query(rf"""
    WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, regexp_replace(unnest(a), '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
         n AS (SELECT doc_id, line_no, CASE {_NAMED} END AS test_name, regexp_extract(line, '(\d+\.?\d*)\s*([a-zA-Z/%]+)?', 1) AS value, regexp_extract(line, '(\d+\.?\d*)\s*([a-zA-Z/%]+)?', 2) AS unit,
                 trim(CASE WHEN regexp_matches(line, 'ref[:\s]*[^,\n]', 'i') THEN regexp_extract(line, 'ref[:\s]*([^,\n]+)', 1, 'i') WHEN regexp_matches(line, 'normal[:\s]*[^,\n]', 'i') THEN regexp_extract(line, 'normal[:\s]*([^,\n]+)', 1, 'i')
                           WHEN regexp_matches(line, 'range[:\s]*[^,\n]', 'i') THEN regexp_extract(line, 'range[:\s]*([^,\n]+)', 1, 'i') ELSE '' END) AS reference_range FROM l)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, test_name, value, unit, md5(reference_range) AS range_md5 FROM n WHERE test_name IS NOT NULL AND value <> ''
""")
def keyword_lines_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents that name a test and hold a number."""
    found = keyword_lines.keyword_results(read(spark, sf_dir, "documents"), id="doc_id", text="text")
    return found.select("doc_id", "line_no", "test_name", "value", "unit", F.md5(F.encode("reference_range", "UTF-8")).alias("range_md5"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, ['cholesterol', 'blood_glucose', 'platelet', 'iron', 'hemoglobin', 'potassium'][1 + l_partkey % 6] AS test_name, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5' AS value,
           ['mg/dL', '%', '', 'ug/L', 'g/dL', 'mEq/L'][1 + l_partkey % 6] AS unit, ['10-40.5', 'erence: < 20.5', '', '10.5 – 30', '> 25.5', '30'][1 + l_partkey % 6] AS reference_range,
           CASE l_partkey % 6 WHEN 0 THEN CASE WHEN l_quantity < 10 THEN 'LOW' WHEN l_quantity > 40 THEN 'HIGH' ELSE 'NORMAL' END WHEN 1 THEN CASE WHEN l_quantity >= 20 THEN 'HIGH' ELSE 'NORMAL' END
               WHEN 3 THEN CASE WHEN l_quantity < 10 THEN 'LOW' WHEN l_quantity >= 30 THEN 'HIGH' ELSE 'NORMAL' END WHEN 4 THEN CASE WHEN l_quantity <= 25 THEN 'LOW' ELSE 'NORMAL' END ELSE 'UNKNOWN' END AS status FROM lineitem
""")
def keyword_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of a report, among lines without a test or a value: test, value, unit, range and status."""
    value = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5"))
    parts = (("LDL Fasting ", " mg/dL Range: 10-40.5, more"), ("FBS ", "% Reference: < 20.5"), ("Plt: ", ""), ("Ferritin ", "ug/L normal 10.5 – 30"), ("Hgb\t", " g/dL ref > 25.5 , fair"), ("Kept at ", " mEq/L range  30"))
    line = F.lit(None).cast("string")
    for i, (before, after) in enumerate(parts):
        line = F.when(F.col("l_partkey") % 6 == i, F.concat(F.lit(before), value, F.lit(after))).otherwise(line)
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("key")
    pages = read(spark, sf_dir, "lineitem").select(key, F.concat(F.lit("We do 5 things\n\nGlucose is high\n  "), line, F.lit(" \nRoom 5")).alias("text"))
    found = keyword_lines.keyword_results(pages, id="key", text="text")
    return found.select("key.*", "test_name", "value", "unit", "reference_range", "status")


@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(o_orderkey % 900 + 1 AS VARCHAR) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN k IN (0, 4) THEN 'pdf' WHEN k = 1 THEN 'photo' WHEN k IN (3, 6) THEN 'ocr' END AS text_source, CASE k WHEN 2 THEN 'photo needs a reader' WHEN 5 THEN 'no text' END AS error, CASE WHEN k IN (1, 6) THEN 'ai' WHEN k IN (0, 3, 4) THEN 'patterns' END AS read_by,
           k NOT IN (2, 5) AS parsed_successfully, CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 60 WHEN 4 THEN 2 WHEN 6 THEN 2 ELSE 0 END AS n_medications,
           CASE WHEN k IN (0, 3, 4) THEN 'Amoxicillin Trihydrate|' || n || ' mg||' WHEN k IN (1, 6) THEN 'Calpol|' || n || '|twice daily|' END AS first, CASE WHEN k IN (0, 3, 4) THEN 'Calpol|' || n || 'ml||' WHEN k IN (1, 6) THEN 'Paracetamol|||5 days' END AS second FROM o
""")
def read_prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as prescriptions: files with a text layer, scans and photos, with replies of a model that are good, unusable or missing."""
    k, n = F.col("o_orderkey") % 7, (F.col("o_orderkey") % 900 + 1).cast("string")
    short = F.concat(F.lit("Tab. Amoxicillin Trihydrate "), n, F.lit(" mg 1-0-1\nno dose at all\nSyp. Calpol "), n, F.lit("ml after food"))
    long = F.concat(F.lit("Dr. Some One\n" + "clinic " * 20 + "\n"), short)
    good = F.concat(F.lit('Here:\n```json\n{"medications": ["none", {"dosage": "1"}, {"medication_name": " Calpol ", "dosage": '), n, F.lit(', "frequency": "twice daily", "duration": null}, {"medication_name": "Paracetamol", "duration": "5 days", "instructions": []}, null]}\n```'))
    files = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k.isin(1, 2), "Scan.JPG").otherwise("sheet.pdf").alias("file_name"), F.when(k == 0, long).when(k == 3, "stray").when(k == 4, short).when(k == 6, " ").alias("layer"),
        F.when(k.isin(1, 6), short).when(k == 3, F.concat(short, F.repeat(F.concat(F.lit("\n"), short), 40))).when(k == 5, " \n").alias("recognised"), F.when(k.isin(1, 6), good).when(k == 0, '{"medications": "none"}').when(k == 3, "[1, 2").when(k.isin(2, 5), good).alias("reply"),
    )
    found = prescriptions.read_prescriptions(files, file_name="file_name", layer="layer", recognised="recognised", reply="reply")
    one = lambda i: F.concat_ws("|", *[F.get("medications", F.lit(i))[f] for f in ("medication_name", "dosage", "frequency", "duration")])
    return found.select("o_orderkey", "text_source", "error", "read_by", "parsed_successfully", F.size("medications").alias("n_medications"), F.when(F.col("parsed_successfully"), one(0)).alias("first"), F.when(F.col("parsed_successfully"), one(1)).alias("second"))

"""Row grammars, patterns held in a table, cover by two keys, and functions that met bad values."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import numbers
from tarnwork.operators import catalog, merging, records, report_text, row_grammars, series, suggestions


def parsed(spark, lines, **more):
    rows = row_grammars.parse_rows(spark.createDataFrame([(x,) for x in lines], "line string"), line="line", **more).collect()
    return {r.line: (r.grammar, r.raw_name, r.value, r.unit, r.reference_range, r.status) for r in rows}


def test_lines_of_all_kinds(spark):
    expected = {
        "Base Excess -4.6 mmol/L -2 - 3": ("tabular", "Base Excess", "-4.6", "mmol/L", "-2 - 3", "LOW"),
        "Glucose <=5 mg/dL": ("tabular", "Glucose", "<=5", "mg/dL", "", "UNKNOWN"),
        "HbA1c 6.5 % Non-diabetic: < 5.7": ("tabular", "HbA1c", "6.5", "%", "Non-diabetic: < 5.7", "HIGH"),
        "Glucose 95 mg/dL 70 - 110 High": ("tabular", "Glucose", "95", "mg/dL", "70 - 110 High", "NORMAL"),
        "Glucose 95 mg/dL Desirable: below 100": ("tabular", "Glucose", "95", "mg/dL", "Desirable: below 100", "UNKNOWN"),
        "Creatinine 1.2 mg/dl 0.7-1.3*": ("tabular", "Creatinine", "1.2", "mg/dl", "0.7-1.3*", "NORMAL"),
        "Hb 13.0 Abnormal 13.5 - 17 g/dL": ("value_range_unit", "Hb", "13.0", "g/dL", "13.5 - 17", "LOW"),
        "HBsAg Weak Positive": ("qualitative", "HBsAg", "Weak Positive", "", "", "UNKNOWN"),
        "Anti HCV Non-Reactive Non-Reactive": ("qualitative", "Anti HCV", "Non-Reactive", "", "Non-Reactive", "NORMAL"),
        "Consistency Semi Fluid Semi Solid": ("descriptive", "Consistency", "Semi Fluid", "", "Semi Solid", "UNKNOWN"),
        "Pus Cells None Seen 0 - 5": ("descriptive", "Pus Cells", "None Seen", "", "0 - 5", "NORMAL"),
        "Blood Group AB": ("categorical", "Blood Group", "AB", "", "", "UNKNOWN"),
        "Vitamin D 30 nmol/L 20 - 50": ("tabular", "Vitamin D", "30", "nmol/L", "20 - 50", "NORMAL"),
        "Synthesis Score 0.50 0.30 - 0.70 calm": ("unitless", "Synthesis Score", "0.50", "", "0.30 - 0.70 calm", "NORMAL"),
        "pH 11.0": ("simple", "pH", "11.0", "", "", "UNKNOWN"),
        "Type of Sample Urine": ("text_pair", "Type of Sample", "Urine", "", "", "UNKNOWN"),
        "Absolute Neutrophils 4.1 thou/mm3 2.0 - 7.0": ("tabular", "Absolute Neutrophils", "4.1", "thou/mm3", "2.0 - 7.0", "NORMAL"),
        "TLC 11,050 cells/cu.mm 4000-10000": ("tabular", "TLC", "11,050", "cells/cu.mm", "4000-10000", "HIGH"),
        "Sample Volume 12.5 ml": ("text_pair", "Sample Volume 12.5", "ml", "", "", "UNKNOWN"),
    }
    none = ["Page 3 of 4", "Name : Jane", "If fever 100", "National Road 12", "Glucose. 5 mg/dL", "Levels of the disease 5 mg/dL", "Visit ID 5", "Differential Count", "MR.JOHN DOE", "1. As per", "ALLERGY SCREEN, SERUM", "Kidney disease", "Cells; type Round", "Cells, Round", "HIV : Negative", "5", "", "ABCDEFGHIJKL", "| a", "Vitamin 5 mg/dL was 20"]
    assert parsed(spark, [*expected, *none[:-1], None]) == expected


def test_continued_lines(spark):
    text = "\n".join(["CORTISOL AFTER", "30 minutes 12.5 µg/dL 5 - 25", "METHOD WORD", "Glucose 95 mg/dL", "", "Absolute Leucocyte Count", "Eosinophils 0.4 thou/mm3", "THYROID PROFILE", "TSH 2.0 µIU/mL"])
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = report_text.parse_report(docs, id="id", text="text").orderBy("line_no").collect()
    assert [(r.line_no, r.raw_name, r.value, r.section) for r in rows] == [
        (0, "CORTISOL AFTER 30 minutes", "12.5", None), (1, "30 minutes", "12.5", None), (2, "METHOD", "WORD", None), (3, "Glucose", "95", None),
        (6, "Eosinophils", "0.4", "alc"), (7, "THYROID", "PROFILE", None), (8, "TSH", "2.0", None),
    ]


@pytest.fixture
def patterns(spark):
    rows = [("b_test", "x", r"(?P<a_name>Qty): (?P<v>\d+) (mg)?", 4, 2, 3, None, True), ("b_test", "low", r"(Qty): (\d)", 1, 2, None, None, True), ("a_test", "off", r"(Qty): (\d+)", 9, 2, None, None, False), ("a_test", "bad", "((", 9, 1, None, None, True)]
    return spark.createDataFrame(rows, "test string, pattern_name string, regex_pattern string, priority int, value_group int, unit_group int, range_group int, is_active boolean")


def test_patterns_of_a_table(spark, patterns):
    lines = spark.createDataFrame([("** qty: 15 mg :: <10 ::",), ("** Qty: 15 :: 3 - 20 ::",), ("none ::",)], "line string")
    read = lambda p: {(r.line, r.pattern_test, r.raw_name, r.value, r.unit, r.reference_range, r.status, round(r.confidence, 6)) for r in row_grammars.parse_rows(lines, line="line", patterns=p).collect() if r.grammar == "pattern"}
    assert read(patterns) == {("** qty: 15 mg :: <10 ::", "b_test", "qty", "15", "mg", "<10", "HIGH", 0.7), ("** Qty: 15 :: 3 - 20 ::", "b_test", "Qty", "15", "N/A", "3 - 20", "NORMAL", 0.6)}
    other = patterns.withColumn("is_active", F.col("is_active") & (F.col("pattern_name") != "x"))
    assert {r[1:5] for r in read(other)} == {("b_test", "qty", "1", "N/A"), ("b_test", "Qty", "1", "N/A")}
    with pytest.raises(ValueError):
        row_grammars.pattern_rows(patterns, most=2)


def test_cover_by_two_keys(spark):
    def plain(adds, rows):
        tests, names = {t for t, _ in rows if t}, {}
        for t, n in rows:
            names.setdefault(n.strip().lower(), set()).add(t) if n and n.strip() else None
        out = []
        for t, n in adds:
            key = (n or "").strip().lower()
            links = names.get(key) if key else None
            known = (t is not None and t in tests) or (links is not None and (t is None or None in links))
            out.append(known)
            if not known:
                tests |= {t} - {None}
                if key:
                    names.setdefault(key, set()).add(t)
        return out

    rng = random.Random(8)
    adds, rows, expected = [], [], {}
    pick = lambda: (rng.choice(["t1", "t2", "t3", None]), rng.choice(["a", "A ", "b", "c", None, " "]))
    for g in range(150):
        mine, have = [pick() for _ in range(rng.randrange(8))], [pick() for _ in range(rng.randrange(3))]
        adds += [(g, i, *a) for i, a in enumerate(mine)]
        rows += [(g, *r) for r in have]
        expected |= {(g, i): c for i, c in enumerate(plain(mine, have))}
    found = records.covered(spark.createDataFrame(adds, "g int, i int, test string, name string"), spark.createDataFrame(rows, "g int, test string, name string"), group="g", test="test", name="name", order="i")
    assert {(r.g, r.i): r.covered for r in found.collect()} == expected


def test_bad_values_end_no_job(spark):
    bad = [("abc",), ("<5",), (None,), ("7",)]
    rows = spark.createDataFrame(bad, "value string").withColumns({"test": F.lit("t"), "unit": F.lit("u"), "k": F.lit(1)})
    rules = spark.createDataFrame([("t", "u", 1, 5, True)], "test string, unit string, normal_min int, normal_max int, is_active boolean")
    assert {(r.value, r.status) for r in catalog.validate_results(rows, rules, rules.where("false")).collect()} == {("abc", "UNKNOWN"), ("<5", "UNKNOWN"), (None, "UNKNOWN"), ("7", "HIGH")}
    assert [(r.n, r.trend) for r in series.half_split(rows, series=["k"], order=["value"], value="value").collect()] == [(1, "STABLE")]
    assert [r[0] for r in rows.select(numbers.convert_exact("value", F.lit(2))).collect()] == [None, None, None, 14]
    assert [r[0] for r in spark.createDataFrame([("5",), ("12.50",), ("-3.",), ("1,000",), ("x",)], "v string").select(numbers.exact_product("v", F.lit("0.08333333").cast("decimal(15,8)"))).collect()] == ["0.41666665", "1.0416666250", "-0.24999999", None, None]


def test_rows_without_values_and_repeated_keys_stay_right(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "row_id int, value string")
    log = spark.createDataFrame([(1, 1, None), (2, 3, "d"), (3, 4, "new"), (4, 5, None)], "change_id int, row_id int, after string")
    assert sorted(map(tuple, suggestions.apply_changes(rows, log).collect())) == [(2, None), (3, "d"), (4, "new")]
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 1)], "row_id int, value string, at int")
    found = merging.upsert(rows.withColumn("at", F.lit(0)), new, keys=["row_id"], order=["at"])
    assert sorted((r.row_id, r.value) for r in found.collect()) == [(1, "y"), (2, None), (3, "c"), (9, "z")]


def test_rows_are_located(spark):
    import re

    texts = {1: ["Glucose 12.5 mg", "glucose 2.5 x", "Ketones +", "Note 2.5", "Glucose: <10 (a.b)", "Sodium 140"], 2: ["Sodium 1140 140.5", "SODIUM (140)", "A\\Eb Sodium \\Q"], 3: []}
    lines = spark.createDataFrame([(d, i, x) for d, t in texts.items() for i, x in enumerate(t)], "doc int, line_no int, line string")
    asked = [(1, "Glucose", "2.5"), (1, "Glucose, F", "12.5"), (1, "Ketones", "+"), (1, "Glucose", "<10"), (1, "Na", "140"), (1, "Sodium", ""), (2, "Sodium", "140"), (2, "Sodium x", "\\Q"), (2, "Sodium", "A\\Eb"), (3, "Sodium", "1"), (1, None, "1"), (1, "Sodium", None)]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, doc int, name string, value string")

    def plain(doc, name, value):
        words, value = re.findall("[a-z]{3,}", (name or "").lower()), (value or "").strip()
        if not words or not value:
            return None
        return next((i for i, x in enumerate(texts[doc]) if words[0] in x.lower() and re.search(rf"(?<![\w.]){re.escape(value)}(?!\w)", x, re.I)), None)

    found = {r.id: r.line_no for r in report_text.locate_rows(rows, lines, doc="doc", id="id", name="name", value="value").collect()}
    assert found == {i: plain(*a) for i, a in enumerate(asked)} and sum(x is not None for x in found.values()) == 7
    recorded = spark.createDataFrame([(0, 5), (1, 99), (4, 2)], "id int, line_no int")
    told = {r.id: r.line_no for r in report_text.locate_rows(rows, lines, doc="doc", id="id", name="name", value="value", recorded=recorded).collect()}
    assert told == found | {0: 5, 4: 2}

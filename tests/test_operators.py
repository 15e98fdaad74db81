"""Operators on small tables."""

import hashlib
import random
import re
from difflib import SequenceMatcher
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from tarnwork.operators import merging, report_text, resolve, scoring, series, suggestions, tables, timeline
from tarnwork.plans import curation

CATALOG = [
    ("alt", "ALT", ["SGPT", "Alanine aminotransferase"]), ("crp", "C-Reactive Protein", ["CRP"]), ("hs_crp", "hs-CRP", ["High sensitivity CRP"]),
    ("bun", "Blood Urea Nitrogen", ["BUN", "Urea Nitrogen"]), ("bun_creatinine_ratio", "BUN/Creatinine Ratio", []), ("esr", "ESR", []),
    ("direct_bilirubin", "Bilirubin Direct", ["Conjugated Bilirubin"]), ("glucose_fasting", "Fasting Glucose", []), ("glucose", "Glucose", []),
    ("urine_glucose", "Urine Glucose", []), ("igg", "IgG", []),
]


def catalog(spark):
    return spark.createDataFrame(CATALOG, "name string, display_name string, aliases array<string>")


def test_names_resolve_to_their_rows(spark):
    cases = {
        "ALT (SGPT), SERUM": "alt", "C-REACTIVE PROTEIN; CRP, SERUM": "crp", "Urea Nitrogen Blood": "bun", "BUN/Creatinine Ratio": "bun_creatinine_ratio",
        "E.S.R.": "esr", "Bilirubin Direct": "direct_bilirubin", "GLUCOSE, FASTING (F), PLASMA (Hexokinase)": "glucose_fasting", "hsCRP": "hs_crp",
        "Herpes simplex virus 1+2, IgG": None, "Mystery Marker": None,
    }
    names = spark.createDataFrame([(k,) for k in cases], "printed string")
    assert {r.printed: r.test for r in resolve.resolve_names(names, catalog(spark), key=["printed"]).collect()} == cases


def test_every_catalog_text_resolves_to_its_own_row(spark):
    cases = {t: name for name, display, aliases in CATALOG for t in (name.replace("_", " "), display, *aliases)}
    names = spark.createDataFrame([(k,) for k in cases], "printed string")
    assert {r.printed: r.test for r in resolve.resolve_names(names, catalog(spark), key=["printed"]).collect()} == cases


def test_sections_values_and_own_links(spark):
    rows = [(1, "Glucose", "urine", "Trace", 7), (2, "Glucose", "urine", "5", 7), (3, "Mystery Marker", None, "1", 7), (4, "mystery marker", None, "1", 8)]
    names = spark.createDataFrame(rows, "id int, printed string, section string, value string, user_id int")
    key = names.where("id = 3").select(resolve.alias_key("printed")).first()[0]
    links = spark.createDataFrame([(7, key, "esr")], "user_id int, match_key string, test string")
    found = resolve.resolve_names(names, catalog(spark), key=["id"], context="section", value="value", links=links, tenant="user_id")
    assert {r.id: r.test for r in found.collect()} == {1: None, 2: "urine_glucose", 3: "esr", 4: None}


def test_points_come_in_one_unit(spark):
    rows = [(1, "a", "13.2", "g/dL", "12 - 16"), (2, "a", "124", "g/L", "120 - 160"), (3, "a", "12.5", "G/DL", ""), (4, "a", "x", "mmol/L", ""), (5, "b", "3", "", "")]
    results = spark.createDataFrame(rows, "id int, s string, v string, u string, r string").withColumn("test", F.lit("hb"))
    factors = spark.createDataFrame([("hb", "g/l", "g/dl", "0.1")], "test string, from_key string, to_key string, factor string").withColumn("factor", F.col("factor").cast("decimal(15,8)"))
    points = series.trend_points(results, factors, series=["s"], test="test", unit="u", value="v", printed_range="r", order=["id"])
    assert [tuple(r) for r in points.orderBy("id").select("trend_unit", "trend_value", "trend_range", "unit_status").collect()] == [
        ("g/dL", "13.2", "12 - 16", "same"), ("g/dL", "12.4", "12 - 16", "converted"), ("g/dL", "12.5", "", "same"), ("mmol/L", "x", "", "unconverted"), ("", "3", "", "same"),
    ]


def test_half_split_gives_the_odd_point_to_the_second_half(spark):
    points = spark.createDataFrame([(1, 1, "10"), (1, 2, "20"), (1, 3, "30"), (1, 4, "x"), (2, 1, "5")], "s int, t int, v string").withColumn("v", F.col("v").try_cast("double"))
    found = {r.s: r for r in series.half_split(points, series=["s"], order=["t"], value="v").collect()}
    assert (found[1].n, found[1].first_mean, found[1].second_mean, found[1].trend) == (3, 10.0, 25.0, "DETERIORATING")
    assert found[2].trend == "STABLE"
    better = series.half_split(points.withColumn("h", F.lit(True)), series=["s"], order=["t"], value="v", higher_is_better="h").collect()
    assert {r.s: r.trend for r in better} == {1: "IMPROVING", 2: "STABLE"}


def test_sections_equal_a_fold(spark):
    lines = ["x", "H1", "a", "b", "END", "c", "H2", "d"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc int, no int, line string")
    found = report_text.carry_section(df, partition=["doc"], order=["no"], header=F.when(F.col("line").startswith("H"), F.col("line")), ends=F.col("line") == "END")
    expected, now = [], None
    for t in lines:
        now = t if t[0] == "H" else None if t == "END" else now
        expected.append(now)
    assert [r.section for r in found.orderBy("no").collect()] == expected


def test_lines_of_a_report_become_rows(spark):
    report = "\n".join(["Patient : X", "Hemoglobin 15.00 g/dL 13.00 - 17.00", "Basophils 1.00 % <2.00", "CRP <10 mg/L <10", "TOTAL LEUCOCYTE COUNT (TLC) 11,050 cells/cu.mm 4000-10000", "Hemoglobin (Hb) 13.00 Normal 13.00 - 17.00 g/dL", "Note: sample hemolyzed", "HBsAg Negative", "HIV : Negative", "URINE EXAMINATION", "Pus cells 2 /hpf", "Hemoglobin 15.00 g/dL 13.00 - 17.00"])
    docs = spark.createDataFrame([(1, report)], "id int, text string")
    rows = report_text.parse_report(docs, id="id", text="text").orderBy("line_no").collect()
    assert [(r.raw_name, r.value, r.unit, r.status, r.section) for r in rows] == [
        ("Hemoglobin", "15.00", "g/dL", "NORMAL", None), ("Basophils", "1.00", "%", "NORMAL", None), ("CRP", "<10", "mg/L", "HIGH", None),
        ("TOTAL LEUCOCYTE COUNT (TLC)", "11,050", "cells/cu.mm", "HIGH", None), ("Hemoglobin (Hb)", "13.00", "g/dL", "NORMAL", None),
        ("HBsAg", "Negative", "", "NORMAL", None), ("Pus cells", "2", "/hpf", "UNKNOWN", "urine"), ("Hemoglobin", "15.00", "g/dL", "NORMAL", "urine"),
    ]


def test_repeated_headers_are_shown_once(spark):
    rows = [(1, 1, 0, "City Laboratory of Medicine"), (1, 1, 1, "pH 6.0 5.0 - 8.0"), (1, 1, 2, "Page 1 of 2"), (1, 2, 0, "City Laboratory of Medicine"), (1, 2, 1, "Disclaimer"), (1, 2, 2, "legal words")]
    lines = spark.createDataFrame(rows, "doc int, page int, pos int, line string")
    shown = report_text.prepare_text(lines, doc=["doc"], page="page", pos="pos", line="line").orderBy("page", "pos").collect()
    assert [r.line for r in shown] == ["City Laboratory of Medicine", "pH 6.0 5.0 - 8.0"]


def test_replacing_readers_win_by_priority(spark):
    base = spark.createDataFrame([("d1", "a", "1"), ("d2", "a", "1")], "doc string, name string, value string")
    extra = spark.createDataFrame([("d1", "a", "9", "replace", 1), ("d1", "b", "8", "replace", 2), ("d2", "a", "7", "supplement", 1), ("d2", "c", "6", "supplement", 1)], "doc string, name string, value string, mode string, priority int")
    found = merging.replace_or_supplement(base, extra, keys=["doc", "name"], group=["doc"])
    assert sorted((r.doc, r.name, r.value) for r in found.collect()) == [("d1", "b", "8"), ("d2", "a", "1"), ("d2", "c", "6")]


def test_assignment_takes_each_row_once(spark):
    expected = spark.createDataFrame([("r", 0, "Hemoglobin", "g/dl"), ("r", 1, "Glucose", "mg/dl")], "report string, no int, name string, unit string")
    parsed = spark.createDataFrame([("r", 0, "Glucose", "mg/dl"), ("r", 1, "Haemoglobin", "g/dl"), ("r", 2, "Glucose fasting", "mg/dl")], "report string, no int, name string, unit string")
    assert sorted((r.expected_no, r.parsed_no) for r in scoring.assign_rows(expected, parsed, report="report").collect()) == [(0, 1), (1, 0)]
    counts = spark.createDataFrame([("r", 2, 3, 2, 1)], "report string, expected long, parsed long, matched long, value_ok long")
    scores = scoring.corpus_scores(counts)
    assert [round(x, 1) for x in scores.select("recall", "precision", "value_accuracy").first()] == [100.0, 66.7, 50.0]
    assert [r.metric for r in scoring.floor_violations(scores, {"recall": 94.0, "precision": 74.0}).collect()] == ["precision"]


def _assigned(expected, parsed, least=0.55):
    """Row by row in plain Python, by the rules of the docstring."""
    found = []
    for report in {r[0] for r in expected}:
        left, right = (sorted(r[1:] for r in rows if r[0] == report) for rows in (expected, parsed))
        used = set()
        for no, a, u in left:
            ranked = []
            for j, (_, b, v) in enumerate(right):
                ratio = SequenceMatcher(None, a, b).ratio()
                ratio = max(ratio, 0.9) if a and a in b else ratio
                ratio = max(ratio, 0.85) if b and b in a else ratio
                if j not in used and ratio >= least:
                    ranked.append((-(ratio + (0.15 if not u or v and (u in v or v in u) else 0)), -ratio, j))
            if ranked:
                score, name, j = min(ranked)
                used.add(j)
                found.append((report, no, right[j][0], round(-score, 9), round(-name, 9)))
    return sorted(found)


def test_assignment_equals_brute_force_also_with_repeated_numbers(spark):
    rng, kind = random.Random(5), "report int, no int, name string, unit string"
    rows = lambda: [(r, rng.randint(1, 5), rng.choice(["ring", "ring bolt", "large ring", "nut", "nuts", ""]), rng.choice(["a", "b", ""])) for r in range(25) for _ in range(rng.randint(1, 9))]
    expected, parsed = rows(), rows()
    for least in (0.55, 0.9):
        found = scoring.assign_rows(spark.createDataFrame(expected, kind), spark.createDataFrame(parsed, kind), report="report", least=least)
        assert sorted((a, b, c, round(d, 9), round(e, 9)) for a, b, c, d, e in found.collect()) == _assigned(expected, parsed, least)


def test_sections_and_units_tell_variants_apart(spark):
    expected = spark.createDataFrame([("r", 0, "Neutrophils", "%"), ("r", 1, "Neutrophils", "thou/mm3")], "report string, no int, name string, unit string")
    parsed = spark.createDataFrame([("r", 0, ["NEUTROPHILS"], "thou/mm3", "alc"), ("r", 1, ["x", "Neutrophils"], "%", "dlc")], "report string, no int, names array<string>, unit string, section string")
    assert sorted((r.expected_no, r.parsed_no, round(r.score, 2)) for r in scoring.assign_rows(expected, parsed, report="report").collect()) == [(0, 1, 1.35), (1, 0, 1.35)]


def test_rows_go_with_their_lines_in_both_budgets(spark):
    units = spark.createDataFrame([(1, i, 10) for i in range(5)], "doc int, no int, size int")
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 3), (1, 6, None), (1, 7, 99)], "doc int, row_id long, no int")
    found = scoring.plan_rows(units, rows, doc="doc", budget=20, row_budget=2).orderBy("part").collect()
    assert [(r.first, r.beyond, r.row_ids) for r in found] == [(0, 1, [1, 6]), (1, 2, [2, 3]), (1, 3, [4, 7]), (3, 5, [5])]


def test_every_line_item_is_assigned(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert curation.assigned_rows(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert curation.queued_orders(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_whole_texts_are_redacted(spark, tmp_path):
    """Every line's addresses and numbers, also of texts without an '@', against plain regular expressions."""
    texts = [(1, "a@b.org, c@d.org\nx e.f@g.net"), (2, "no mail\nTel: 020 1234 5678\nID 12345678901 and +44 20 7946 0958"), (3, "[REDACTED] h@i.org\n\n"), (4, None), (5, "Tel: 020 1234 5678\n99")]
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 5").collect()]
    spark.createDataFrame(texts + real, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cue = re.compile(r"(\b(?:tel|telephone|phone|mob|mobile|cell|contact|call|helpline|whatsapp|toll\s*free|fax)\b\.?(?:\s*(?:no|number)\b\.?)?\s*[:\-]?\s*)(\+?\d[\d\s()./-]{6,}\d)", re.I | re.A)

    def line(text):
        count = 0
        for pattern, mark in ((r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", None), (cue, 2), (r"(?<![\w+])\+\d{1,3}[\s-]?\d[\d\s-]{6,}\d", None), (r"(?<![\d.,/])\d{10,}(?![\d.,/])", None)):
            keep = lambda m, mark=mark: m[0] if mark and sum(map(str.isdigit, m[2])) < 8 else (m[1] if mark else "") + "[REDACTED]"
            found = re.compile(pattern, 0 if mark else re.A)
            count += sum(keep(m) != m[0] for m in found.finditer(text))
            text = found.sub(keep, text)
        return text, count

    expected = {}
    for i, text in texts + real:
        told = [line(x) for x in (text or "").split("\n")]
        expected[i] = (hashlib.sha256("\n".join(t for t, _ in told).encode()).hexdigest(), sum(n for _, n in told))
    found = {r.doc_id: (r.text_sha256, r.n_redacted) for r in curation.redacted_texts(spark, str(tmp_path)).collect()}
    assert found == expected and [found[i][1] for i in (1, 2, 3, 4, 5)] == [3, 3, 1, 0, 1]


def test_parts_stay_in_budget(spark):
    lines = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 20, 1, 9, 1])], "doc int, no int, size int")
    found = scoring.plan_parts(lines, doc="doc", order="no", size="size", budget=10).orderBy("no").collect()
    assert [r.part for r in found] == [0, 0, 1, 2, 2, 3]


def test_a_failing_reader_gives_no_rows(spark):
    good = SimpleNamespace(name="g", priority=1, mode="supplement", matches=lambda t: "x" in t, parse=lambda t: [("n", t)])
    bad = SimpleNamespace(name="b", priority=2, mode="replace", matches=lambda t: True, parse=lambda t: 1 / 0)
    docs = spark.createDataFrame([(1, "x1"), (2, "y")], "id int, text string")
    assert [(r.id, r.format, r.value) for r in scoring.plugin_rows(docs, [good, bad], id="id", text="text").collect()] == [(1, "g", "x1")]


def test_changes_apply_and_are_undone_unless_rows_moved_on(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_id long, value string")
    raw = spark.createDataFrame([(1, 1, "update", 1, "z", "printed z"), (1, 2, "remove", 2, None, ""), (1, 3, "update", 3, "c", "c"), (1, 4, "update", 9, "q", "q"), (1, 5, "update", 1, "y", "not there")], "report_id long, suggestion_id long, action string, row_id long, value string, text string")
    clean = suggestions.clean_suggestions(raw, rows, text="text")
    assert sorted(r.suggestion_id for r in clean.collect()) == [1, 2]
    log = suggestions.change_log(clean, rows)
    now = suggestions.apply_changes(rows, log)
    assert sorted(map(tuple, now.collect())) == [(1, "z"), (3, "c")]
    back, conflicts = suggestions.undo_changes(now, log)
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b"), (3, "c")] and not conflicts.collect()
    moved = now.withColumn("value", F.when(F.col("row_id") == 1, "changed").otherwise(F.col("value")))
    _, conflicts = suggestions.undo_changes(moved, log)
    assert [r.row_id for r in conflicts.collect()] == [1]


def test_tables_in_text(spark):
    html = "<table><tr><th>Test</th><th>Value</th></tr><tr><td>Hb &amp; x</td><td><b>13</b></td></tr></table><table><tr><td>no</td></tr></table>"
    assert spark.range(1).select(tables.html_rows(F.lit(html))).first()[0] == [["Test", "Value"], ["Hb & x", "13"]]
    assert spark.range(1).select(tables.text_cells(F.lit("| a | b c |"))).first()[0] == ["a", "b c"]
    assert spark.range(1).select(tables.text_cells(F.lit("|---|:--|"))).first()[0] is None
    reply = 'Sure:\n```json\n{"k": 5}\n```'
    assert spark.range(1).select(tables.json_in_text(F.lit(reply), "struct<k: int>")).first()[0].k == 5


def test_timeline_begins_on_the_first_day_and_has_no_end(spark):
    rows = spark.createDataFrame(pd.DataFrame({"tenant": [1, 1, 1], "day": ["2026-01-01", "2026-04-02", "2027-01-01"], "text": list("abc")}))
    found = timeline.timeline({"x": rows}, today=F.lit("2026-07-02").cast("date"), period="3m")
    assert sorted(r.text for r in found.collect()) == ["b", "c"]


def test_text_pairs_come_last_and_leave_prose_alone(spark):
    lines = ["Type of Sample Urine", "Crystals Absent", "Kidney disease", "Cells; type Round", "Cells, Round", "Glucose 96"]
    rows = report_text.parse_rows(spark.createDataFrame([(x,) for x in lines], "line string"), line="line").collect()
    assert {(r.line, r.grammar, r.raw_name, r.value) for r in rows} == {
        ("Type of Sample Urine", "text_pair", "Type of Sample", "Urine"),
        ("Crystals Absent", "qualitative", "Crystals", "Absent"),
        ("Glucose 96", "simple", "Glucose", "96"),
    }


def test_reply_phases_skip_silent_chunks(spark):
    from tarnwork.operators import context

    rows = [(1, 0, None, None), (1, 1, "", "a"), (1, 2, "\n<think>", None), (1, 3, "b </th", None), (1, 4, "ink>", None), (1, 5, "c", "d"), (2, 0, "x <think>", None), (3, 0, None, "a"), (3, 1, None, "")]
    chunks = spark.createDataFrame(rows, "reply int, n int, content string, reasoning string")
    found = context.reply_phases(chunks, reply=["reply"], order=["n"], content="content", reasoning="reasoning").orderBy("reply", "n").collect()
    assert [(r.reply, r.n, r.reasoning_tokens, r.reply_tokens, r.phase) for r in found] == [
        (1, 1, 1, 0, "thinking"), (1, 2, 2, 0, "thinking"), (1, 3, 3, 0, "thinking"), (1, 4, 4, 0, "thinking"), (1, 5, 4, 1, "writing"),
        (2, 0, 0, 1, "writing"), (3, 0, 1, 0, "thinking"),
    ]


def test_rows_are_normalised_by_catalog_section_and_range(spark):
    from tarnwork.operators import context

    rows = [
        (1, "Urine Creatinine", "90", "mg/dL", "20 - 100", "HIGH", None),
        (2, "Creatinine", "1.1", "mg/dL", "0.7 - 1.3", "UNKNOWN", None),
        (3, "Creatinine", "60", "mg/dL", "see note", "UNKNOWN", ""),
        (4, "Mrs. Jane Roe", "42", None, None, "UNKNOWN", None),
        (5, "Neutrophils (DLC)", "80", "%", "40 - 70", "UNKNOWN", None),
        (6, "Mystery Marker", "3", None, None, "LOW", None),
        (7, None, "3", None, None, "LOW", None),
    ]
    schema = "row_id int, name string, value string, unit string, printed string, status string, section string"
    tests = [("creatinine", "Creatinine", None), ("urine_creatinine", "Creatinine, Urine", None), ("dlc_neutrophils", "Neutrophils (DLC)", ["Neutrophils"])]
    catalog = spark.createDataFrame(tests, "name string, display_name string, aliases array<string>")
    bounds = ("min_value", "max_value", "normal_min", "normal_max", "critical_low_min", "critical_high_max")
    rules = spark.createDataFrame([("urine_creatinine", "mg/dL", *[None] * 2, 20, 50, *[None] * 2, True)], "test string, unit string, " + ", ".join(f"{b} int" for b in bounds) + ", is_active boolean")
    rules = rules.withColumns({b: F.col(b).cast("decimal(18,4)") for b in bounds})
    defaults = spark.createDataFrame([("urine_creatinine", "mg/dL")], "test string, unit string")
    limits = spark.createDataFrame([("creatinine", 1.3)], "name string, normal_max double")
    found = context.normalized_rows(spark.createDataFrame(rows, schema), catalog, rules, defaults, limits).orderBy("row_id").collect()
    assert [(r.row_id, r.name, r.display_name, r.status, r.section) for r in found] == [
        (1, "urine_creatinine", "Creatinine, Urine", "NORMAL", "urine"), (2, "creatinine", "Creatinine", "NORMAL", None),
        (3, "urine_creatinine", "Creatinine, Urine", "HIGH", ""), (5, "dlc_neutrophils", "Neutrophils (DLC)", "HIGH", "dlc"), (6, "Mystery Marker", "Mystery Marker", "LOW", None),
    ]

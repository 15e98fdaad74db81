"""Recognised pages against plain loops."""

import random

from pyspark.sql import functions as F

from tarnwork.operators import recognised

PIECES = {"Glucose": "name", "Vitamin D": "name", "LIPID PANEL": "skip", "(method)": "skip", "Page 2": "skip", "Mr. Roe": "skip", "12.5": "value ref", "1,050": "value ref", "-3": "value", "<10": "value ref", "5%": "value ref", "Weak  Positive": "value", "nil": "value", "mg/dL": "unit", "mL/min/1.73 m^2": "unit", "%": "unit", "10 - 40": "ref", ">= 5 \\( x \\)": "ref", "  ": ""}


def plain_groups(lines):
    lines = [" ".join(x.replace("\\(", "").replace("\\)", "").replace("m^2", "m2").split()) for x in lines]
    kinds = {" ".join(k.replace("\\(", "").replace("\\)", "").replace("m^2", "m2").split()): v for k, v in PIECES.items()}
    lines = [x for x in lines if x]
    has = lambda i, kind: i < len(lines) and kind in kinds[lines[i]].split()
    out, i = [], 0
    while i < len(lines):
        if has(i, "skip") or not has(i + 1, "value"):
            i += 1
            continue
        row, j = [i, lines[i], lines[i + 1], "", ""], i + 2
        if has(j, "unit"):
            row[3], j = lines[j], j + 1
        if has(j, "ref"):
            row[4], j = lines[j], j + 1
        out.append(tuple(row))
        i = j
    return out


def test_lines_are_grouped_as_by_a_loop(spark):
    rng = random.Random(4)
    pages = [[rng.choice(list(PIECES)) for _ in range(rng.randrange(14))] for _ in range(400)]
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pages)] + [(-1, None)], "id int, text string").repartition(2)
    found = {r.id: [tuple(x) for x in r.rows] for r in docs.select("id", recognised.line_groups("text").alias("rows")).collect()}
    assert found == {i: plain_groups(p) for i, p in enumerate(pages)} | {-1: []}


def test_predicates(spark):
    lines = {
        "mg/dL": "u", "MG/DL": "", "ML/MIN/1.73m²": "u", "12.5": "vr", "Nil": "v", "semi solid": "v", "11,050": "vr", "<5": "vr", "5 - 9": "r", "%": "u", "Dr Roe": "s", "name of": "s", "(x": "s", "KIDNEY PANEL": "s", "seen by Ms. Li": "s", "Glucose": "",
    }
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    flags = F.concat(*[F.when(f("x"), k).otherwise("") for k, f in (("u", recognised.is_unit), ("v", recognised.is_value), ("r", recognised.is_reference), ("s", recognised.is_no_name))])
    assert {r.x: r.f for r in df.select("x", flags.alias("f")).collect()} == lines


def plain_columns(header):
    import re

    kinds = {k: p.replace("(?i)", "") for k, p in recognised.COLUMNS.items()}
    places = {}
    if any(re.search(kinds[k], " ".join(header), re.I) for k in ("name", "value", "ref")):
        for i, cell in enumerate(header):
            for k, p in kinds.items():
                if k not in places and re.search(p, cell, re.I):
                    places[k] = i
                    break
    by_width = {5: "name value unit ref status", 4: "name value unit ref", 3: "name value ref"}.get(min(len(header), 5), "name value")
    told = bool(places)
    return {**dict.fromkeys(kinds), **(places or {k: i for i, k in enumerate(by_width.split())}), "told": told}


def test_headers_tell_columns(spark):
    rng, words = random.Random(1), ["Test Name", "Result", "Units", "Ref. Range", "Flag", "Observed Value", "Glucose", "95", "x", "UoM", "Normal", "Interpretation", "value name"]
    headers = [[rng.choice(words) for _ in range(rng.randrange(1, 7))] for _ in range(200)]
    df = spark.createDataFrame([(h,) for h in headers], "h array<string>")
    found = df.select(recognised.columns_of(F.col("h"), F.size("h")).alias("c")).collect()
    assert [r.c.asDict() for r in found] == [plain_columns(h) for h in headers]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "<table><tr><td> </td></tr>"), (4, "<table><tr><td>Hb</td><td>13</td></tr>"), (5, "| Hb | 13 |\n|--|--|\n| Note | 5 |\n| Na | 140 |"), (6, "a\tb\tc"), (7, "Test  Result  Flag\nHb  12 x  H\nHb  12  ABNORMAL  HIGH")], "id int, text string")
    found = {(r.id, r.row_no, r.name, r.value, r.reference_range, r.status) for r in recognised.read_tables(docs, id="id", text="text").collect()}
    assert found == {(4, 0, "Hb", "13", "", "UNKNOWN"), (5, 0, "Hb", "13", "", "UNKNOWN"), (5, 2, "Na", "140", "", "UNKNOWN"), (7, 2, "Hb", "12", "", "UNKNOWN")}


def test_only_what_was_read_badly_is_read_again(spark):
    good = "\n".join(f"Test {c} 5 mg/dL" for c in "abcdefghij")
    docs = spark.createDataFrame([(1, good), (2, good), (3, "x" * 600), (4, "x"), (5, None), (6, "Hb 5 mg/dL\n" + "y" * 600)], "id int, text string")
    first = spark.createDataFrame([(1, f"n{i}", "5") for i in range(5)] + [(2, f"n{i}", "5") for i in range(4)] + [(3, "a", "1"), (4, "B", "1"), (4, "B", "1"), (6, "a", "1")], "id int, name string, value string")
    seen = []

    def second(some):
        seen.extend(r.id for r in some.collect())
        return spark.createDataFrame([(2, "N0", "5"), (2, "new", "1"), (2, "new", "1"), (4, "b", "1"), (5, "c", "2")], "id int, name string, value string")

    rows, told = recognised.hybrid_rows(docs, first, second, id="id", text="text", keys=[F.lower("name"), F.col("value")])
    assert sorted(seen) == [2, 4, 5]
    assert {r.id: (r.n_rows, r.n_lines, r.sufficient, r.n_added, r.reader) for r in told.collect()} == {
        1: (5, 10, True, 0, "first"), 2: (4, 10, False, 1, "both"), 3: (1, 0, True, 0, "first"), 4: (2, 0, False, 0, "first"), 5: (0, 0, False, 1, "second"), 6: (1, 1, True, 0, "first"),
    }
    assert rows.count() == first.count() + 2

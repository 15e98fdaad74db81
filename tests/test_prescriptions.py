"""Lines read by keywords against a plain loop, and prescriptions by example."""

import random
import re

from pyspark.sql import functions as F

from tarnwork.operators import keyword_lines, prescriptions

LINES = [
    "Glucose 95.5 mg/dL Reference: 70-110", "Plt 150. ref:,", "ref 5", "HDL <5", "K 4.1 range:  , 3 - 5", "Fasting sugar 80 to 90 normal: 70 – 99, fine", "TSH none", "   ", "Vitamin B12 200 pg", "K 12", "kalium 7%normal > 5",
    "HbA1c 6.5 %", "Sgpt 41u/l NORMAL < 41", "t3 1", "ALBUMIN 3.5g ref 3.5-5.0 range 1-2", "12 folate", "zzz 5", "Iron: 5\t%", "creat 1.2 Range 5 - 1",
]


def _slow(line):
    """What a line gives, read with Python's own expressions."""
    line = line.strip()
    name = next((n for n, words in keyword_lines.KEYWORDS.items() if re.search(words, line, re.I)), None)
    value = re.search(r"([0-9]+\.?[0-9]*)\s*([a-zA-Z/%]+)?", line)
    if not name or not value:
        return None
    told = next((m[1].strip() for m in (re.search(rf"{w}[:\s]*([^,\n]+)", line, re.I) for w in keyword_lines.RANGE_WORDS) if m), "")
    v, status = float(value[1]), "UNKNOWN"
    if m := re.search(r"(\d+\.?\d*)\s*[-–]\s*(\d+\.?\d*)", told):
        status = "LOW" if v < float(m[1]) else "HIGH" if v > float(m[2]) else "NORMAL"
    elif m := re.search(r"<\s*(\d+\.?\d*)", told):
        status = "HIGH" if v >= float(m[1]) else "NORMAL"
    elif m := re.search(r">\s*(\d+\.?\d*)", told):
        status = "LOW" if v <= float(m[1]) else "NORMAL"
    return name, value[1], value[2] or "", told, status, line


def test_keyword_lines_equal_a_loop(spark):
    rng = random.Random(3)
    tokens = "HDL k 5 4.5 12. ref reference : normal range - – < > , mg/dL % iron x to   \t".split(" ")
    lines = LINES + ["".join(rng.choice(tokens) + rng.choice(["", " "]) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    rows = [(1, "\n".join(lines)), (2, ""), (3, None), (1, "Glucose 5")]
    found = keyword_lines.keyword_results(spark.createDataFrame(rows, "id int, text string"), id="id", text="text").collect()
    expected = [(1, i, *r) for i, line in enumerate(lines) if (r := _slow(line))] + [(1, 0, *_slow("Glucose 5"))]
    assert sorted(map(tuple, found)) == sorted(expected) and len(expected) > 400


def test_texts_of_files(spark):
    long = "a" * 120
    cases = {
        ("a.pdf", long, None): (long, "pdf", None), ("a.pdf", "b" * 30_000, "seen"): ("b" * 20_000, "pdf", None), ("a.pdf", "a" * 119 + "  ", "seen "): ("seen", "ocr", None), ("a.pdf", "stray", ""): ("stray", "ocr", None),
        ("a.pdf", "stray", None): ("stray", "pdf", None), ("a.pdf", None, None): (None, None, prescriptions.NO_SCAN_READER), ("a.pdf", "", " "): (None, None, prescriptions.EMPTY_FILE), (None, None, "s" * 20_001): ("s" * 20_000, "ocr", None),
        ("A.HEIC", long, None): (None, None, prescriptions.NO_PHOTO_READER), ("b.png", None, "\n"): (None, None, prescriptions.EMPTY_PHOTO), ("b.png", None, " x "): ("x", "photo", None),
    }
    df = spark.createDataFrame([(*k,) for k in cases], "n string, l string, r string").select("*", prescriptions.chosen_text("n", "l", "r").alias("t"))
    assert {(r.n, r.l, r.r): tuple(r.t) for r in df.collect()} == cases


def test_medicines(spark):
    texts = {
        "Tab. Amoxicillin 500mg 1-0-1": [("Amoxicillin", "500mg")], "Take Vitamin C 5 tablets\nIron Folic Acid  2\tcapsule": [("Iron Folic Acid", "2\tcapsule")], "calpol 5 ml": [], "": [],
        "\n".join(f"Calpol {i} ml" for i in range(70)): [("Calpol", f"{i} ml") for i in range(60)], "A" + "b" * 250 + " 5 mg": [("A" + "b" * 199, "5 mg")], "Dolo 650 mg Calpol 5 ml": [("Dolo", "650 mg")],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", prescriptions.printed_medications("t").alias("m"))
    assert {r.t: [(m.medication_name, m.dosage) for m in r.m] for r in df.collect()} == texts
    item = '{"medication_name": " A ", "dosage": 5, "frequency": false, "duration": null, "instructions": "' + "i" * 3000 + '"}'
    replies = {
        None: 0, "": 0, "none": 0, "{}": 0, '{"medications": {}}': 0, f"[{item}]": 0, f'[{{"medications": [{item}]}}]': 0, f'{{"medications": [{item}, "x", null, 5, {{}}, {{"medication_name": " "}}]}}': 1,
        f'<think>{{"medications": []}}</think> so: {{"medications": [{item}, {item}]}} done': 2, '{"medications": [' + ", ".join([item] * 61) + "]}": 60, '{"medications": [': 0,
    }
    df = spark.createDataFrame([(t,) for t in replies], "t string").select("t", prescriptions.replied_medications("t").alias("m"))
    found = {r.t: r.m for r in df.collect()}
    assert {t: len(m) for t, m in found.items()} == replies
    assert all(tuple(x) == ("A", "5", "", "", "i" * 2000) for m in found.values() for x in m)


def test_prescriptions_without_a_text_have_no_medicines(spark):
    good = '{"medications": [{"medication_name": "A"}]}'
    rows = [(1, "a.jpg", None, None, good), (2, "a.jpg", None, "Dolo 5 mg", "no json"), (3, "a.jpg", None, "Dolo 5 mg", good), (4, "a.pdf", "words", None, None)]
    files = spark.createDataFrame(rows, "id int, name string, layer string, seen string, reply string")
    read = lambda df: prescriptions.read_prescriptions(df, file_name="name", layer="layer", recognised="seen", reply="reply")
    found = read(files).select("id", "read_by", F.transform("medications", lambda m: m["medication_name"]), "parsed_successfully").orderBy("id").collect()
    assert list(map(tuple, found)) == [(1, None, [], False), (2, "patterns", ["Dolo"], True), (3, "ai", ["A"], True), (4, "patterns", [], False)]
    assert read(files.where("false")).count() == 0

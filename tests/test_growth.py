"""Steps whose cost once grew faster than their input, or that were done more than once."""

import random
import re

from pyspark.sql import functions as F

from tarnwork.functions import numbers, text
from tarnwork.functions.text import one_spaced, trimmed
from tarnwork.operators import catalog, keyword_lines, recognised, records, relinking, report_text, resolve, row_grammars, scoring, series, trends
from tarnwork.plans import recognition
from tarnwork.session import discard, materialize


def test_actionable_lines_are_read_once(spark):
    texts = ["ab\r1", "a1\n1 ab", "x ab y 2 z\nab1\n", "a b 1", "abcdefghij" * 3_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: (r.n_chars, r.n_actionable) for r in records.actionable_lines(docs, id="id", text="text").collect()}
    assert found == {0: (4, 1), 1: (7, 0), 2: (14, 2), 3: (5, 0), 4: (30_000, 0), 5: (0, 0)}


def counted(spark):
    """A function of texts that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(text):
        calls.add(1)
        return text

    return calls, F.udf(same, "string")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_first_reader_reads_once(spark):
    calls, same = counted(spark)
    docs = spark.createDataFrame([(i, f"Hb {i} mg/dL") for i in range(20)], "id int, text string")
    first = docs.select("id", same("text").alias("name"), F.lit("5").alias("value"))
    second = lambda some: some.select("id", F.lit("other").alias("name"), F.lit("5").alias("value"))
    rows, told = recognised.hybrid_rows(docs, first, second, id="id", text="text", keys=[F.col("name")])
    assert {(r.n_rows, r.n_lines, r.n_added, r.reader) for r in told.collect()} == {(1, 1, 1, "both")}
    assert rows.count() == 40 and calls.value == 20


def test_pages_for_two_readers_are_made_once(spark):
    told = recognition.two_readers(spark, "/root/testdata/sf0.001")
    assert "collect_list" not in optimized(told) and told.count() > 0


def test_lines_that_are_alike_are_judged_once(spark, monkeypatch):
    calls, same = counted(spark)
    fits = recognised.fits
    monkeypatch.setattr(recognised, "fits", lambda line, *kinds: fits(same(line), *kinds[:1]))
    long = "Hb 5 mg/dL " + "x" * recognised.LONG_LINE
    docs = spark.createDataFrame([(i, f"Hb 5 mg/dL\n\nNa {i % 2} mmol/L\nsome words\n{long}") for i in range(40)] + [(40, None), (41, "")], "id int, text string")
    found = recognised.reading_quality(docs, spark.createDataFrame([(0, "a")], "id int, name string"), id="id", text="text")
    assert {(r.id, r.n_lines) for r in found.collect()} == {(i, 3) for i in range(40)} | {(40, 0), (41, 0)}
    # Long lines one by one; each runs the function for what a pattern needs and for the pattern.
    assert calls.value <= 2 * (40 + 4)


def test_clean_lines_stay_as_cleaning_leaves_them(spark):
    rng = random.Random(8)
    bits = ["\\(", "\\)", "m^2", "m^", "m", "²", "2", "(", ")", "\\", " ", "\u2003", "x", "µ"]
    texts = ["", "m^²", "m^\\(²", " \\( x \\) "] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(3_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("t", one_spaced("t"))
    assert df.where(~recognised.cleaned(F.col("t")).eqNullSafe(recognised.clean_line("t"))).count() == 0


def test_recognised_pages_are_read_once(spark):
    calls, same = counted(spark)
    docs = spark.createDataFrame([(1, "a\tHb\t5"), (2, "Hb\n5"), (3, "<table><tr><td>Hb</td><td>1</td></tr><tr><td>Na</td><td>2</td></tr></table>"), (4, "")], "id int, text string").select("id", same("text").alias("text"))
    found = recognised.read_recognised(docs, id="id", text="text")
    assert sorted((r.id, r.source, r.name) for r in found.collect()) == [(2, "lines", "Hb"), (3, "table", "Hb"), (3, "table", "Na")]
    assert calls.value <= 8


def test_reports_are_parsed_once(spark):
    calls, same = counted(spark)
    docs = spark.createDataFrame([(i, "Hb 5 mg/dL\nNa 140 mmol/L") for i in range(10)], "id int, text string").select("id", same("text").alias("text"))
    tests = spark.createDataFrame([("hb", "Hb", ["hb"])], "name string, display_name string, aliases array<string>")
    found = report_text.parse_report(docs, id="id", text="text", catalog=tests)
    assert sorted((r.id, r.raw_name, r.test) for r in found.collect()) == sorted((i, n, t) for i in range(10) for n, t in (("Hb", "hb"), ("Na", None)))
    assert calls.value == 10


def test_tables_and_lines_are_taken_apart_once(spark):
    docs = spark.createDataFrame([(1, "x")], "id int, text string")
    assert optimized(recognised.read_tables(docs, id="id", text="text")).count("(?is)<table") == 1
    assert optimized(recognised.read_line_groups(docs, id="id", text="text")).count("m^2") <= 3


def test_white_space_and_noise_are_as_their_patterns_say(spark):
    spaces = "".join(chr(c) for c in range(0x3001))
    texts = [f"{a}{c}x{c}{c}y{c}{a}" for c in spaces for a in ("", " ")] + ["", " ", "a\n", "a \n", " a  b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.where(~trimmed("t").eqNullSafe(plain) | ~one_spaced("t").eqNullSafe(F.regexp_replace(plain, r"(?U)\s+", " "))).count() == 0
    lines = ["Page 1 of 2", " name : x", "x Name : y", "seen by Mr. x", "x HOD", "Reported : x", "(a", "x (a", "reported within 24 hours", "If x", "xIf ", "1. x", "x 1. x"]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    every = F.col("t").rlike("(?i)" + "|".join(row_grammars.NOISE)) | F.col("t").rlike("|".join(row_grammars.NOISE_AS_IT_IS))
    assert df.where(row_grammars.is_noise("t") != every).count() == 0


def edit_of(n):
    return (None, f"Own x{n}y", ["Shared name"], "each", 1, 2, True)


EDITS = "name string, display_name string, aliases array<string>, default_unit string, normal_min int, normal_max int, is_active boolean"


def test_many_edits_that_claim_one_name_make_no_pairs(spark):
    n = 3_000
    edits = spark.createDataFrame([edit_of(i) for i in range(n)], EDITS)
    known = spark.createDataFrame([("a", "Alone", [], "each", 1, 2, True)], EDITS)
    found = {r.display_name: r.problem for r in relinking.checked_edits(known, edits, spark.createDataFrame([("each",)], "name string")).collect()}
    assert found == {f"Own x{i}y": "names own_x1000y" if i == 0 else "names own_x0y" for i in range(n)}
    pairs = relinking._read_as(edits.withColumn("name", F.translate(F.lower("display_name"), " ", "_")), edits.withColumn("name", F.translate(F.lower("display_name"), " ", "_")), several=True)
    assert pairs.count() == n


def test_names_read_as_other_tests_as_by_pairs(spark):
    rng = random.Random(5)
    words = ["iron", "zinc", "free iron", "iron urine", "zinc, iron", "lead (iron)"]
    tests = [(f"t{i}", f"own{i}", rng.sample(words, rng.randrange(3))) for i in range(14)]
    known = spark.createDataFrame(tests, "name string, display_name string, aliases array<string>")
    asked = known.select(F.col("name").alias("_test"), F.explode(F.array_distinct(F.concat(F.array("name", "display_name"), "aliases"))).alias("_text"))
    asked = asked.withColumn("_with", resolve.qualifiers_of("_text")).select("*", F.posexplode(resolve.readings_of("_text")).alias("_at", "_r"))
    pairs = asked.join(resolve.catalog_readings(known), (F.col("_r.key") == F.col("key")) & (F.col("_test") != F.col("test"))).where("size(array_except(required, _with)) = 0 AND size(array_except(_with, allowed)) = 0").collect()
    for several in (False, True):
        expected = {}
        for test, text in {(r._test, r._text) for r in pairs}:
            for at in sorted({r._at for r in pairs if (r._test, r._text) == (test, text)}):
                others = {r.test for r in pairs if (r._test, r._text, r._at) == (test, text, at)}
                if several or len(others) == 1:
                    expected.setdefault((test, text), min(others))
        assert {(r.name, r.text): r.other for r in relinking._read_as(known, known, several).collect()} == expected


def test_rows_of_few_units_are_not_dealt_out_by_them(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(50).select("id", F.lit("x").alias("test"), F.lit("each").alias("unit"), F.col("id").cast("string").alias("value"), F.lit("dz").alias("to_unit"), F.lit("1 - 2").alias("printed"))
        units = spark.createDataFrame([("each", "ea"), ("dozen", "dz")], "name string, symbol string")
        conversions = spark.createDataFrame([("x", "each", "dozen", True)], "test string, from_unit string, to_unit string, is_active boolean").withColumn("conversion_factor", F.lit("2").cast("decimal(15,8)"))
        rules = spark.createDataFrame([("x", "each", 1, 2, True)], "test string, unit string, normal_min int, normal_max int, is_active boolean")
        factors = spark.createDataFrame([("x", "dz", "each", "2")], "test string, from_key string, to_key string, factor string").withColumn("factor", F.col("factor").cast("decimal(15,8)"))
        points = series.trend_points(rows, factors, series=["id"], test="test", unit="unit", value="value", printed_range="printed", order=["id"])
        told = (catalog.convert_results(rows, units, conversions), catalog.rules_by_printed_unit(rows, rules, rules.select("test", "unit")), points)
        keys = [line for df in told for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if re.search(r"SortMergeJoin|ShuffledHashJoin", line) and not re.search(r"\[id#", line)]
        assert keys == [] and [df.count() for df in told] == [50, 50, 50]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keywords_are_found_as_by_their_patterns(spark):
    rng = random.Random(3)
    words = [w for ws in keyword_lines.KEYWORDS.values() for w in ws.split("|")]
    lines = ["", "İron", "ſodium", "K 5", "é iron", *(rng.choice(["", "x", "é "]) + rng.choice([str.upper, str.title, str.lower])(w) + rng.choice("x ") for w in words for _ in range(3))]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    by_pattern = F.coalesce(*[F.when(F.col("x").rlike(f"(?iu){ws}"), name) for name, ws in keyword_lines.KEYWORDS.items()])
    assert df.where(~keyword_lines.keyword_of("x").eqNullSafe(by_pattern)).count() == 0
    assert "contains" in optimized(df.select(keyword_lines.keyword_of("x"))).lower()


def test_parts_are_planned_as_lines_come(spark):
    rng = random.Random(2)
    lines = [(doc, no, rng.randrange(900)) for doc in (None, *range(30)) for no in range(rng.randrange(1, 40))]
    found = scoring.plan_parts(spark.createDataFrame(lines, "doc int, no int, size int"), doc="doc", order="no", size="size", budget=2000)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    expected, used, part, last = {}, 0, 0, ()
    for doc, no, size in lines:
        if last != (doc,):
            last, used, part = (doc,), 0, 0
        if used and used + size > 2000:
            used, part = 0, part + 1
        used += size
        expected[doc, no] = part
    assert {(r.doc, r.no): r.part for r in found.collect()} == expected


def test_words_that_no_row_asks_for_are_not_dealt_out(spark):
    lines = spark.createDataFrame([(d, n, f"xyz x{d}y{n} {n}.5 <{n} mg/dL +++ %") for d in range(3) for n in range(9)], "doc int, line_no int, line string")
    rows = spark.createDataFrame([(1, 0, "Xyz", "4.5"), (2, 1, "xyz", "+++"), (3, 2, "xyz", "%"), (4, 2, "xyz", "9.5"), (5, 1, "1 xyz", "7"), (6, 0, "xyz", "")], "id int, doc int, name string, value string")
    found = report_text.locate_rows(rows, lines, doc="doc", id="id", name="name", value="value")
    assert {r.id: r.line_no for r in found.collect()} == {1: 4, 2: 0, 3: 0, 4: None, 5: 7, 6: None}
    assert re.search(r"Join LeftSemi[^\n]*_slot", optimized(found))


def test_rows_to_locate_are_not_broadcast(spark):
    # Ten thousand rows in a file of a few kilobytes, as equal columns take nearly no room there.
    lines = materialize(spark.range(10_000).select(F.col("id").alias("doc"), F.lit(0).alias("line_no"), F.lit("Xyz 4.5").alias("line")), "test-lines")
    words = F.split("line", " ")
    rows = lines.select("doc", F.col("doc").alias("id"), words[0].alias("name"), words[1].alias("value"))
    found = report_text.locate_rows(rows, lines, doc="doc", id="id", name="name", value="value", recorded=rows.select("id", F.lit(0).alias("line_no")))
    assert found.where("line_no = 0").count() == 10_000
    joins = re.findall(r"HashJoin [^\n]*", found._jdf.queryExecution().executedPlan().toString())
    # The slots of words are broadcast alone, of which there are few however many rows there are.
    assert len(joins) == 1 and "_slot" in joins[0]
    discard(lines)


def test_lines_that_are_alike_are_read_once(spark, monkeypatch):
    texts = ["Hb 5.5 mg/dL 1 - 4", " Hb 5.5 mg/dL 1 - 4", "HIV Negative", "Page 1 of 2", "", None, "ABO Group AB"]
    lines = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(700)], "id int, line string")
    each = row_grammars.parse_rows(lines, line="line")
    given, whole = [], row_grammars.parse_rows
    monkeypatch.setattr(row_grammars, "parse_rows", lambda rows, **options: (given.append(rows.count()), whole(rows, **options))[1])
    for most, read in ((10, 6), (2, 700)):
        found = row_grammars.parse_repeated_rows(lines, line="line", most=most)
        assert found.columns == each.columns and sorted(found.collect()) == sorted(each.collect()) and found.count() == 400
        assert given.pop() == read


def prepared(spark, pages):
    lines = spark.createDataFrame([("s", page, pos, line) for page, text in pages for pos, line in enumerate(text)], "source string, page int, pos int, line string")
    return report_text.prepare_text(lines, doc=["source"], page="page", pos="pos", line="line")


def test_a_repeated_line_is_no_group_of_its_own(spark):
    pages = [(p, [*([""] * 3), "An address that is long enough", f"Hb {p} g/dL", ""]) for p in range(40)] + [(0, ["twice"]), (0, ["twice"])]
    found = prepared(spark, pages)
    assert sorted((r.page, r.pos, r.line) for r in found.collect()) == sorted([(0, 3, "An address that is long enough"), (0, 0, "twice"), (0, 0, "twice"), *((p, 4, f"Hb {p} g/dL") for p in range(40))])
    windows = [w for w in optimized(found).split("\n") if "Window [" in w]
    assert windows and all(re.search(r"\], \[source#\d+, (page|_page)#", w) for w in windows)


def test_guards_of_patterns_leave_nothing_out(spark):
    rng = random.Random(7)
    bits = ["Mr. Roe", "MRS Roe", "b/o Roe", "baby\tRoe", "Patient Name : Jane Roe", "test name: x", "name:Kim", "Kumari Roe", "a.b@c.de", "@", "call 12345 678", "Toll Free no: 1800-123-4567", "+91 98765 43210", "12345678901", "1,234.5", "clinically correlate",
            "Clinical correlation", "Medico - legal", "www.x", "HTTPS://x", "End  of the report", "computer generated", "terms & conditions", "inter laboratory", "İmr x", "systems", "3 - 5", "< 4", ">=7", "5.", "1e5", "<abc", "<=1,200.5x", "within 2 days", "ms. x", "hod", "Courts/Forum"]
    texts = [rng.choice(["", " ", "x", "é"]) .join(rng.sample(bits, rng.randrange(1, 4))) for _ in range(3_000)] + bits + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = rf"(?i)(?<![A-Za-z])(?<!test\s{{0,9}})((?:{text.NAME_LABELS})\s*:\s*(?:(?:{text.TITLES}|dr)\b[.'\-]*\s+)*){text._NAME}", rf"(?i)(?<![A-Za-z])((?:{text.TITLES})\b\.?\s+){text._NAME}"
    plain = F.col("t")
    for pattern in names:
        plain = F.regexp_replace(plain, pattern, "$1[REDACTED]")
    assert df.where(~text.redact_names("t").eqNullSafe(plain)).count() == 0 and df.where(plain.contains("REDACTED")).count() > 500
    plain = F.regexp_replace("t", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "[REDACTED]")
    cue = r"(?i)(\b(?:tel|telephone|phone|mob|mobile|cell|contact|call|helpline|whatsapp|toll\s*free|fax)\b\.?(?:\s*(?:no|number)\b\.?)?\s*[:\-]?\s*)(?=(?:\D*\d){8})\+?\d[\d\s()./-]{6,}\d"
    for pattern, mark in ((cue, "$1[REDACTED]"), (r"(?<![\w+])\+\d{1,3}[\s-]?\d[\d\s-]{6,}\d", "[REDACTED]"), (r"(?<![\d.,/])\d{10,}(?![\d.,/])", "[REDACTED]")):
        plain = F.regexp_replace(plain, pattern, mark)
    assert df.where(~text.redact_contacts("t").eqNullSafe(plain)).count() == 0 and df.where(plain.contains("REDACTED")).count() > 500
    every = F.col("t").rlike(text.BOILERPLATE)
    assert df.where(every & ~text.is_boilerplate("t")).count() == 0 and df.where(every).count() > 500
    assert "contains" in optimized(df.select(text.redact_line("t"))).lower()
    value = F.replace(F.trim("t"), F.lit(","), F.lit(""))
    bound = F.regexp_extract(value, r"^[<>]=?\s*(-?\d+(?:\.\d+)?)", 1)
    whole = F.when(value.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), value)
    assert df.where(~numbers.comparable_number("t").eqNullSafe(F.when(bound != "", bound).otherwise(whole).try_cast("double"))).count() == 0
    assert df.where(row_grammars.holds_unit(F.col("t")) != F.lower("t").rlike("|".join(re.escape(u.lower()) for u in row_grammars.UNITS))).count() == 0


def test_results_of_trends_are_made_once(spark):
    calls, same = counted(spark)
    results = spark.createDataFrame([(i, "hb" if i % 2 else None, "Hb", "g", str(i), "1 - 2") for i in range(20)], "id int, test string, printed string, unit string, value string, range string").select("*", same("value").alias("told"))
    asked = spark.createDataFrame([(1, 1, "test_type", "hb"), (1, 2, "name", "HB")], "user_id int, at int, kind string, value string")
    tests = spark.createDataFrame([("hb", "Hb", ["hb"], "g")], "name string, display_name string, aliases array<string>, default_unit string")
    factors = spark.createDataFrame([("hb", "g", "kg", "1000")], "test_type string, from_key string, to_key string, factor string").withColumn("factor", F.col("factor").cast("decimal(15,8)"))
    wanted = trends.asked_series(asked, tests, tenant="user_id")
    points = trends.several_trends(results.withColumn("user_id", F.lit(1)), wanted, factors, tenant="user_id", test="test", name="printed", unit="unit", value="told", printed_range="range", order=["id"])
    heads = trends.trend_heads(points, wanted, tenant="user_id")
    assert sorted((r.trend_key, r.unit, r.points) for r in heads.collect()) == [("name:hb|", "g", 10), ("type:hb", "g", 10)]
    assert points.count() == 20 and calls.value <= 20


def test_adds_are_dealt_out_by_one_key(spark):
    rng = random.Random(4)
    names = [None, "", " ", "a", " A", "b", "c"]
    adds = [(g, i, rng.choice([None, "x", "y", "z"]), rng.choice(names)) for g in range(60) for i in range(rng.randrange(1, 9))]
    rows = [(g, rng.choice([None, "x", "y"]), rng.choice(names)) for g in range(60) for _ in range(rng.randrange(3))]
    found = records.covered(spark.createDataFrame(adds, "g int, at int, test string, name string"), spark.createDataFrame(rows, "g int, test string, name string"), group="g", test="test", name="name", order="at")
    key = lambda n: " ".join((n or "").lower().split()) or None
    has = {g: [(t, key(n)) for h, t, n in rows if h == g] for g in range(60)}
    expected = {}
    for g, at, test, name in adds:
        n = key(name)
        by_name = [t for t, m in has[g] if n is not None and m == n]
        covered = (test is not None and any(t == test for t, _ in has[g])) or (bool(by_name) and (test is None or None in by_name))
        expected[g, at] = covered
        if not covered:
            has[g].append((test, n))
    assert {(r.g, r.at): r.covered for r in found.collect()} == expected
    assert "<=>" not in optimized(found)

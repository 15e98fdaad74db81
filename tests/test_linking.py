"""Matching again after edits: the touched results alone give what all of them give."""

import random

from pyspark.sql import functions as F

from tarnwork.operators import relinking

CATALOG = "name string, display_name string, aliases array<string>, default_unit string, normal_min int, normal_max int, is_active boolean"


def catalog_of(spark, *rows):
    return spark.createDataFrame([(n, d, a, "u", 1, 2, True) for n, d, a in rows], CATALOG)


def test_names_follow_what_was_recorded(spark):
    catalog = catalog_of(spark, ("glucose", "Glucose", []), ("sodium", "Sodium", []))
    results = [(1, 1, "Glucose", "glucose", "5"), (2, 1, "My sugar", None, "6"), (3, 1, "Sodium", None, "7"), (4, 1, "Twice", None, "8"), (5, 2, "Old name", "sodium", "9"), (6, 2, "Sodium", "sodium", "10")]
    recorded = [(1, 1, "GLUCOSE, F", None, "glucose", "5", "urine"), (2, 1, "GLUCOSE", "Glucose", None, "6", ""), (None, 1, "NA+", "x", "Sodium ", " 7", None), (None, 1, "a", "Twice", None, "8", None), (None, 1, "b", "twice", None, "8", None), (6, 2, "Natrium", "zz", None, "10", None)]
    found = relinking.printed_names(spark.createDataFrame(results, "result_id int, report_id int, test_name string, test string, value string"), spark.createDataFrame(recorded, "result_id int, report_id int, raw_test_name string, test_name string, display_name string, value string, section_context string"), catalog)
    assert {r.result_id: (r.printed, r.section, r.from_parser) for r in found.collect()} == {
        1: ("GLUCOSE, F", "urine", True), 2: ("My sugar", None, False), 3: ("NA+", None, True), 4: ("Twice", None, False), 5: ("Old name", None, False), 6: ("Natrium", None, True),
    }


def test_touched_results_alone_give_the_whole_outcome(spark):
    rng, words = random.Random(9), ["alpha", "beta", "gamma", "delta", "urine alpha", "free beta"]
    for _ in range(2):
        name = lambda: " ".join(rng.sample(words, rng.randrange(1, 3)))  # noqa: E731,B023
        rows = {f"t{i}": (f"t{i}", name().title(), [name() for _ in range(rng.randrange(3))]) for i in range(8)}
        before = catalog_of(spark, *rows.values())
        edits = catalog_of(spark, ("t1", "Alpha Two", ["gamma delta"]), ("t9", "Epsilon", ["beta"])).withColumn("is_active", F.col("name") != "t1")
        after = relinking.proposed(before, edits)
        results = [(i, i % 3, rng.choice([name(), name() + ", SERUM", "x"]), "mg", "5", rng.choice([None, "urine"]), rng.random() < 0.7) for i in range(60)]
        bare = spark.createDataFrame(results, "result_id int, tenant int, printed string, unit string, value string, section string, from_parser boolean").withColumns({"test": F.lit(None).cast("string"), "test_name": F.col("printed")})
        links = spark.createDataFrame([(1, "alpha", "alpha|", "t1"), (2, "gamma", "gamma|", "t3")], "tenant int, name string, match_key string, test string")
        options = {"links": links, "tenant": "tenant"}
        linked = relinking.relinked(relinking.relink(bare, before, **options), bare.columns).cache()
        rows_of = lambda frame: sorted(map(str, frame.select("result_id", "test", "test_name", "new_test", "new_name", "changed").collect()))
        whole, some = relinking.relink(linked, after, **options), relinking.relink_touched(linked, relinking.name_index(linked), before, after, **options)
        assert rows_of(some) == rows_of(whole) and any("changed=True" in r for r in rows_of(whole))


def test_conflicts_and_edits(spark):
    catalog = catalog_of(spark, ("glucose", "Glucose", ["Blood Sugar", "Dextrose"]), ("sugar", "Sugar", []), ("urine_sugar", "Urine Sugar", []), ("x", "Dextrose test", None))
    assert {(r.name, r.text, r.other) for r in relinking.conflicting_names(catalog).collect()} == {("glucose", "Blood Sugar", "sugar"), ("glucose", "Dextrose", "x"), ("sugar", "sugar", "glucose"), ("sugar", "Sugar", "glucose"), ("x", "Dextrose test", "glucose")}
    edits = [("a", "Sodium", ["Na"], "u", 1, 2, True), (None, "Natrium (Na)", [], "u", 1, 2, True), ("b c", "B", [], "u", 1, 2, True), ("d", " ", [], "u", 1, 2, True), ("e", "E1", [], "w", 1, 2, True), ("f", "F1", [], "u", 3, 2, True), ("g", "Urine sugar", [], "u", None, 2, True), ("h", "Urine sugar", [], "u", None, 2, False), ("glucose", "Glucose", ["Dextro"], "u", 1, 2, True)]
    found = relinking.checked_edits(catalog, spark.createDataFrame(edits, CATALOG), spark.createDataFrame([("u",)], "name string"))
    assert {(r.name, r.display_name): r.problem for r in found.collect()} == {
        ("a", "Sodium"): "names natrium_na", ("natrium_na", "Natrium (Na)"): "names a", ("b c", "B"): "no key", ("d", ""): "no name to show", ("e", "E1"): "unknown unit",
        ("f", "F1"): "range upside down", ("g", "Urine sugar"): "names urine_sugar", ("h", "Urine sugar"): None, ("glucose", "Glucose"): None,
    }

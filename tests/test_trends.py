"""Trends asked for by test, printed name and typed search."""

import pytest

from tarnwork.operators import trends

RESULTS = [
    # id, user, date, test, printed name, value, unit
    (1, 1, "2026-05-01", "hemoglobin", "Hemoglobin (Hb)", "13.2", "g/dL"),
    (2, 1, "2026-06-01", "hemoglobin", "Hemoglobin", "124", "g/L"),
    (3, 1, "2026-05-01", "glucose", "Glucose", "96", "mg/dL"),
    (4, 1, "2026-05-01", None, "Mystery Marker", "3.1", "ng/mL"),
    (5, 1, "2026-06-01", None, "MYSTERY, MARKER", "4.0", "ng/mL"),
    (6, 1, "2026-07-01", None, "hemoglobin", "Negative", ""),
    (7, 2, "2026-05-01", "hemoglobin", "Hemoglobin", "15.0", "g/dL"),
]


@pytest.fixture(scope="module")
def ask(spark):
    catalog = spark.createDataFrame(
        [("hemoglobin", "Hemoglobin", ["Hb"], "g/dL"), ("glucose", "Glucose", ["Blood sugar"], "mg/dL")],
        "name string, display_name string, aliases array<string>, default_unit string",
    )
    results = spark.createDataFrame([(*r, "12 - 16") for r in RESULTS], "id long, user_id long, day string, test string, printed string, value string, unit string, range string")
    factors = spark.createDataFrame([("hemoglobin", "g/l", "g/dl", "0.1")], "test_type string, from_key string, to_key string, factor string").selectExpr("test_type", "from_key", "to_key", "CAST(factor AS DECIMAL(15, 8)) AS factor")

    def run(*asked, most=10):
        table = spark.createDataFrame([(u, at, k, v) for at, (u, k, v) in enumerate(asked)], "user_id long, at int, kind string, value string")
        series = trends.asked_series(table, catalog, tenant="user_id", most=most).cache()
        points = trends.several_trends(results, series, factors, tenant="user_id", test="test", name="printed", unit="unit", value="value", printed_range="range", order=["day", "id"])
        heads = trends.trend_heads(points, series, tenant="user_id").orderBy("user_id", "at").collect()
        found = {}
        for p in points.orderBy("day", "id").collect():
            found.setdefault((p.user_id, p.trend_key), []).append((p.id, p.trend_value, p.unit_status))
        return heads, found

    return run


def test_series_by_test_name_and_search(ask):
    heads, found = ask((1, "test_type", "hemoglobin"), (1, "name", " mystery marker "), (1, "parameter", "blood sugar"), (2, "test_type", "hemoglobin"), (2, "test_type", "none such"), (2, "parameter", "mystery marker"))
    assert found[1, "type:hemoglobin"] == [(1, "13.2", "same"), (2, "12.4", "converted")]
    assert found[1, "type:glucose"] == [(3, "96", "same")]
    assert [i for i, *_ in found[1, "name:marker mystery|"]] == [4, 5]
    assert found[2, "type:hemoglobin"] == [(7, "15.0", "same")] and len(found) == 4
    told = {(h.user_id, h.at): (h.trend_name, h.trend_test, h.unit, h.points, h.unconverted) for h in heads}
    assert told == {
        (1, 0): ("Hemoglobin", "hemoglobin", "g/dL", 2, 0), (1, 1): ("mystery marker", None, "ng/mL", 2, 0), (1, 2): ("Glucose", "glucose", "mg/dL", 1, 0),
        (2, 3): ("Hemoglobin", "hemoglobin", "g/dL", 1, 0), (2, 4): ("none such", None, "", 0, 0), (2, 5): ("mystery marker", None, "", 0, 0),
    }


def test_a_typed_search_takes_results_without_a_test_of_that_very_name(ask):
    heads, found = ask((1, "parameter", "Hemoglobin"), (1, "parameter", "MYSTERY MARKER"))
    assert [i for i, *_ in found[1, "type:hemoglobin"]] == [1, 2, 6]
    assert [i for i, *_ in found[1, "name:marker mystery|"]] == [4]


def test_one_key_asked_for_twice_is_one_series(ask):
    heads, _ = ask((1, "parameter", "Hemoglobin"), (1, "test_type", "hemoglobin"), (1, "parameter", "Hb"))
    assert [(h.at, h.kind, h.points) for h in heads] == [(1, "test_type", 2)]


def test_too_many_are_refused_by_tenant_and_blanks_do_not_count(ask):
    heads, found = ask((1, "test_type", "hemoglobin"), (1, "test_type", "glucose"), (1, "name", "x"), (2, "test_type", "hemoglobin"), (2, "name", "  "), (2, "name", None), (2, "colour", "red"), most=2)
    assert [(h.user_id, h.problem, h.points) for h in heads] == [(1, "more than 2 trends", 0), (2, None, 1)]
    assert set(found) == {(2, "type:hemoglobin")}


def test_chosen_reports_seen_rows_and_catalog_lines_with_nulls(spark):
    from pyspark.sql import functions as F

    from tarnwork.operators import records

    codes = lambda *c: spark.createDataFrame([(x,) for x in c], "code string")
    found = records.chosen_reports(codes("a", "a", "b", "x", None), codes("a", "b", "c", "b"), codes("a", "a", "x"), code="code")
    assert {(r.code, r.known, r.empty) for r in found.collect()} == {("a", True, False), ("b", True, True), ("x", False, False), (None, False, False)} and found.count() == 4
    places = spark.createDataFrame([(2,), (1,), (4,), (None,)], "at int")
    assert [r[0] for r in places.select(records.row_seen(F.col("at"), F.lit(2), F.lit(4))).collect()] == [True, False, False, False]
    tests = spark.createDataFrame([("a", "A", list("pqrstuvw"), "g"), ("b", None, None, None), ("c", "C", [], "blank")], "name string, display_name string, aliases array<string>, default_unit string")
    units = spark.createDataFrame([("g", "gram"), ("blank", "")], "name string, symbol string")
    assert {r.line for r in records.catalog_lines(tests, units).collect()} == {"a: A [gram] (p, q, r, s, t, u)", "b:  []", "c: C [blank]"}

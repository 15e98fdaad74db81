"""Changes, filters and shapes of tables of records that several callers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import one_spaced


def cascade(children: DataFrame, gone: DataFrame, *, key: str, parent: str, keep: bool = False) -> DataFrame:
    """``children`` without those of ``gone`` parents; with ``keep`` they stay, without a parent."""
    if not keep:
        return children.join(gone.select(F.col(key).alias(parent)).distinct(), parent, "left_anti").select(*children.columns)
    marked = children.join(gone.select(F.col(key).alias("_gone")).distinct(), F.col(parent) == F.col("_gone"), "left")
    return marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == parent else F.col(c) for c in children.columns])


def change_states(rows: DataFrame, wanted: DataFrame, *, id: str = "id", state: str = "state") -> DataFrame:  # noqa: A002
    """``rows`` with ``moved``: a row moves to ``new`` of ``wanted(id, old, new)`` only if it is still in the state ``old``.

    Of several wishes for one row the first by old and new state counts.
    """
    one = wanted.groupBy(F.col(id).alias("_id")).agg(F.min(F.struct("old", "new")).alias("_w"))
    told = rows.join(one, F.col(id) == F.col("_id"), "left")
    moved = F.coalesce(F.col(state) == F.col("_w.old"), F.lit(False))
    return told.select(*[F.when(moved, F.col("_w.new")).otherwise(F.col(c)).alias(c) if c == state else F.col(c) for c in rows.columns], moved.alias("moved"))


def append_history(history: DataFrame, finished: DataFrame, *, keys: list[str]) -> DataFrame:
    """``history`` and a row for each of ``finished`` that isn't there yet, so that a second run adds nothing."""
    return history.unionByName(finished.dropDuplicates(keys).join(history.select(*keys), keys, "left_anti").select(*history.columns))


def nested(parents: DataFrame, children: DataFrame, *, key: str, of: str, columns: list[str], name: str) -> DataFrame:
    """``parents`` with an array ``name`` of their children's ``columns``, in their order; empty without children.

    A parent's children have to fit into one row.
    """
    row = F.struct(*columns)
    lists = children.groupBy(F.col(of).alias("_of")).agg(F.array_sort(F.collect_list(row)).alias(name))
    told = parents.join(lists, F.col(key) == F.col("_of"), "left").drop("_of")
    kind = "array<" + children.select(row.alias("r")).schema["r"].dataType.simpleString() + ">"
    return told.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def not_equal(column: Column | str, value: object) -> Column:
    """As an exclusion: rows without a value stay."""
    return ~(F.col(column) if isinstance(column, str) else column).eqNullSafe(F.lit(value))


def without_noise(rows: DataFrame, *, status: str, confidence: str, least: float = 0.5) -> DataFrame:
    """Without rows of unknown status that a reader is at most ``least`` sure of; one that says nothing is sure."""
    sure = F.coalesce(F.col(confidence).cast("string").try_cast("double"), F.lit(1.0))
    return rows.where((F.lower(F.coalesce(status, F.lit(""))) != "unknown") | (sure > least))


def plottable(points: DataFrame, *, number: Column, day: str, status: str) -> DataFrame:
    """Points with a number and a day whose unit is the series' own."""
    return points.where((F.col(status) != "unconverted") & number.isNotNull() & F.col(day).isNotNull())


def covered(adds: DataFrame, rows: DataFrame, *, group: str, test: str, name: str, order: str) -> DataFrame:
    """``adds`` with ``covered``: whether ``rows``, or an earlier add that isn't covered itself, has the result already.

    A result is known by its test. It is also known by its name, whatever its case and spaces, unless both the add and
    all rows of that name are linked to tests, which then differ. Both tables have ``group, test, name``. Adds that rows
    cover are found by joins; of those left, equal ones count once, and the different ones of a group are decided in order.
    """
    key = F.nullif(F.lower(one_spaced(F.coalesce(F.col(name), F.lit("")))), F.lit(""))
    tests = rows.where(F.col(test).isNotNull()).select(F.col(group).alias("_g1"), F.col(test).alias("_t1")).distinct()
    names = rows.select(F.col(group).alias("_g2"), key.alias("_n2"), F.col(test).alias("_t2")).where("_n2 IS NOT NULL").groupBy("_g2", "_n2").agg(F.bool_or(F.col("_t2").isNull()).alias("_unlinked"))
    # A null test and a null name are no key: such adds are never covered. Keys hold no null, so that joins and the
    # window deal rows out alike and sort them once; joins with ``rows`` see distinct keys alone.
    by = ["_g", "_bare", "_test", "_name"]
    told = adds.withColumns({"_g": F.col(group), "_bare": F.col(test).isNull(), "_test": F.coalesce(F.col(test).cast("string"), F.lit("")), "_name": F.coalesce(key, F.lit(""))})
    told = told.withColumn("_again", F.row_number().over(Window.partitionBy(*by).orderBy(order)) > 1)
    keyed = ~F.col("_bare") | (F.col("_name") != "")
    keys = adds.select(F.col(group).alias("_g"), F.col(test).isNull().alias("_bare"), F.col(test).alias("_t"), F.coalesce(key, F.lit("")).alias("_name"), F.col(order).alias("_o"))
    keys = keys.where(keyed).groupBy("_g", "_bare", "_t", "_name").agg(F.when(~F.bool_or(F.col("_o").isNull()), F.min("_o")).alias("_o"))
    keys = keys.join(tests, (F.col("_g") == F.col("_g1")) & (F.col("_t") == F.col("_t1")), "left").join(names, (F.col("_g") == F.col("_g2")) & (F.col("_name") == F.col("_n2")), "left")
    keys = keys.select("_g", "_bare", "_t", "_name", "_o", (F.col("_t1").isNotNull() | (F.col("_unlinked").isNotNull() & (F.col("_bare") | F.col("_unlinked")))).alias("_known"))
    open_ = keys.where("NOT _known").groupBy("_g").agg(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_t").alias("t"), F.nullif("_name", F.lit("")).alias("n")))).alias("_adds"))
    kinds = {c: adds.schema[c].dataType.simpleString() for c in (test,)}
    start = F.struct(F.array().cast(f"array<{kinds[test]}>").alias("tests"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("bare"), F.array().cast(f"array<struct<t: {kinds[test]}, n: string>>").alias("gone"))

    def step(s: Column, x: Column) -> Column:
        by_test = x["t"].isNotNull() & F.array_contains(s["tests"], x["t"])
        by_name = x["n"].isNotNull() & F.when(x["t"].isNull(), F.array_contains(s["names"], x["n"])).otherwise(F.array_contains(s["bare"], x["n"]))
        gone = F.coalesce(by_test, F.lit(False)) | F.coalesce(by_name, F.lit(False))
        put = lambda to, value, when: F.when(~gone & when, F.array_append(to, value)).otherwise(to)
        return F.struct(
            put(s["tests"], x["t"], x["t"].isNotNull()).alias("tests"), put(s["names"], x["n"], x["n"].isNotNull()).alias("names"),
            put(s["bare"], x["n"], x["n"].isNotNull() & x["t"].isNull()).alias("bare"), F.when(gone, F.array_append(s["gone"], F.struct(x["t"].alias("t"), x["n"].alias("n")))).otherwise(s["gone"]).alias("gone"),
        )

    gone = open_.select("_g", F.explode(F.aggregate("_adds", start, step, lambda s: s["gone"])).alias("x")).select("_g", F.col("x.t").alias("_t"), F.coalesce("x.n", F.lit("")).alias("_name"))
    gone = gone.union(keys.where("_known").select("_g", "_t", "_name"))
    gone = gone.select("_g", F.col("_t").isNull().alias("_bare"), F.coalesce(F.col("_t").cast("string"), F.lit("")).alias("_test"), "_name", F.lit(True).alias("_gone"))
    return told.join(gone, by, "left").select(*adds.columns, (F.col("_gone").isNotNull() | (F.col("_again") & keyed)).alias("covered"))


def confidence_summary(rows: DataFrame, *, by: list[str], confidence: str, sure: float = 0.7) -> DataFrame:
    """``by`` with ``n``, the mean confidence and the number of rows above ``sure``; without confidences the mean is 0."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("mean_confidence"), F.count_if(F.col(confidence) > sure).alias("n_sure"))


def text_tail(text: Column | str, most: int = 8000, note: str = "[Earlier text is left out]\n") -> Column:
    """The last ``most`` characters, with a note before them if there are more."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > most, F.concat(F.lit(note), F.right(text, F.lit(most)))).otherwise(text)


def context_windows(parts: DataFrame, lines: DataFrame, *, doc: str, margin: int = 15) -> DataFrame:
    """``doc, part, line_no, inside``: lines of ``parts(doc, part, first, beyond)`` and up to ``margin`` around them.

    Lines are joined by the number of their window of ``margin`` lines, so no range of all pairs is tried.
    """
    spans = parts.select(doc, "part", "first", "beyond", F.explode(F.sequence(F.floor((F.col("first") - margin) / margin), F.floor((F.col("beyond") - 1 + margin) / margin))).alias("_cell"))
    told = lines.select(doc, "line_no", F.floor(F.col("line_no") / margin).alias("_cell")).join(spans, [doc, "_cell"])
    inside = (F.col("line_no") >= F.col("first")) & (F.col("line_no") < F.col("beyond"))
    return told.where((F.col("line_no") >= F.col("first") - margin) & (F.col("line_no") < F.col("beyond") + margin)).select(doc, "part", "line_no", inside.alias("inside"))


def expired(status: Column | str, queued_at: Column | str, started_at: Column | str, now: Column) -> Column:
    """Running for over an hour, or queued for over a day."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    hours = lambda c, n: as_col(c) < now - F.make_dt_interval(hours=F.lit(n))
    return F.coalesce(((as_col(status) == "running") & hours(started_at, 1)) | ((as_col(status) == "queued") & hours(queued_at, 24)), F.lit(False))


def dismissed_keys(keys: Column | str, new: Column | str, most: int = 500) -> Column:
    """Dismissed keys with new ones after them, each once, the last ``most``."""
    both = F.array_distinct(F.concat(keys, new))
    return F.when(F.size(both) > most, F.slice(both, F.size(both) - most + 1, F.lit(most))).otherwise(both)


def safe_fix(action: Column | str, changes: Column | str, safe: tuple[str, ...] = ("unit", "reference_range", "status")) -> Column:
    """An update of ``safe`` fields alone."""
    kind = F.col(action) if isinstance(action, str) else action
    fields = F.map_keys(changes)
    return (kind == "update") & (F.size(fields) > 0) & (F.size(F.array_except(fields, F.array(*[F.lit(f) for f in safe]))) == 0)


def finish_run(suggestions: DataFrame, runs: DataFrame, dismissed: DataFrame, *, report: str, run: str, key: str) -> DataFrame:
    """What a finished run may write: the suggestions of each report's current run that weren't dismissed."""
    current = runs.select(report, F.col("current_run").alias(run))
    return suggestions.join(current, [report, run], "left_semi").join(dismissed.select(report, key).distinct(), [report, key], "left_anti").select(*suggestions.columns)


def table_text(rows: DataFrame, *, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``by`` with ``text``: a line ``a | b | c`` for each row, in order; blank cells are left out."""
    cells = F.array_join(F.filter(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), lambda x: x != ""), " | ")
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("line")))).alias("_rows"))
    return lists.select(*by, F.array_join(F.transform("_rows", lambda r: r["line"]), "\n").alias("text"))


def one_unit(points: DataFrame, *, by: list[str], unit: Column) -> DataFrame:
    """``by`` with ``scale``: ``value`` if all series share one unit, else ``indexed``."""
    return points.groupBy(*by).agg(F.when(F.countDistinct(unit) == 1, "value").otherwise("indexed").alias("scale"))


def actionable_lines(docs: DataFrame, *, id: str, text: str) -> DataFrame:  # noqa: A002
    """``id`` with the length of the text without white space around it, and its lines that hold two letters and then a digit.

    A line is read once: whatever digit follows two letters follows the line's first two, so the pattern never goes back.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"(?s)^(?>.*?[A-Za-z]{2}).*\d"))
    return docs.select(id, F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \n\t\r"))).cast("long").alias("n_chars"), F.size(lines).cast("long").alias("n_actionable"))


def catalog_lines(catalog: DataFrame, units: DataFrame, most: int = 6) -> DataFrame:
    """``name`` with ``line``, ``name: display name [unit's symbol] (aliases)``, of which the first ``most`` are given."""
    symbols = units.groupBy(F.col("name").alias("default_unit")).agg(F.min("symbol").alias("_symbol"))
    told = catalog.join(symbols, "default_unit", "left")
    aliases = F.array_join(F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, most), ", ")
    unit = F.coalesce(F.nullif("_symbol", F.lit("")), "default_unit", F.lit(""))
    return told.select("name", F.concat("name", F.lit(": "), F.coalesce("display_name", F.lit("")), F.lit(" ["), unit, F.lit("]"), F.when(aliases != "", F.concat(F.lit(" ("), aliases, F.lit(")"))).otherwise("")).alias("line"))


def chosen_reports(wanted: DataFrame, reports: DataFrame, expected: DataFrame, *, code: str) -> DataFrame:
    """Each code of ``wanted`` once, whether ``reports`` has it (``known``), and whether nothing is expected of it (``empty``).

    A null code is never known. All three tables are made distinct by ``code`` before they are joined.
    """
    flags = reports.select(code).distinct().withColumn("_known", F.lit(True)), expected.select(code).distinct().withColumn("_expected", F.lit(True))
    told = wanted.select(code).distinct().join(flags[0], code, "left").join(flags[1], code, "left")
    known = F.coalesce("_known", F.lit(False))
    return told.select(code, known.alias("known"), (known & ~F.coalesce("_expected", F.lit(False))).alias("empty"))


def row_seen(at: Column, first: Column, beyond: Column) -> Column:
    """Whether a row's printed place lies in the lines that were shown; a row that isn't printed wasn't seen."""
    return F.coalesce((at >= first) & (at < beyond), F.lit(False))

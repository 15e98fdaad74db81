"""Pages read by a recogniser: tables whose columns are told by their header, and rows written over several lines.

Also the plan of two readers: a cheap one reads every document, and only those it has not read well enough go to the
other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.status import flag_status
from tarnwork.functions.text import col, once, one_spaced, trimmed
from tarnwork.operators.merging import first_occurrence
from tarnwork.operators.report_text import explode_lines
from tarnwork.operators.row_grammars import NUMBER, QUALITATIVE_VALUES, UNITS, WORD_RESULT, fits, read_alike
from tarnwork.operators.tables import html_rows
from tarnwork.session import materialize

# What a cell or line holds, lines that are no names, and the words that tell a table's columns.
VALUE = rf"(?iu)^(?:{NUMBER}%?|{WORD_RESULT})$"
REFERENCE = r"^\d|^[<>]"
FILTRATION_UNIT = r"(?i)^mL/min/1\.73\s*m2?$"
NO_NAME = (
    r"(?i)^(?:Page\s+\d|Test\s+Name|Results|Units|Bio\.?\s*Ref|Test\s+Report|Dr\s|Regd\.|Web:|Name|Lab\s+No|Age|Ref\s+By|Gender|Collected|Reported|A/c"
    r"|Report\s+Status|Processed|National|Sector|DELHI|If\s+Test|Tel:|Note|Interpretation|SWASTHFIT|.*PANEL.*|Courts/Forum|Consultant|Technical|Senior|NRL\s+-)"
)
TITLE = r"(?i)\b(?:mr|mrs|ms|miss)\.\s*[a-z]"
COLUMNS = {
    "name": r"(?i)test|investigation|parameter|analyte|name|description|component",
    "value": r"(?i)result|value|reading|observed",
    "unit": r"(?i)unit|uom",
    "ref": r"(?i)ref|range|interval|normal|reference",
    "status": r"(?i)status|flag|remark|interpretation",
}
HEADER_COLUMNS = ("name", "value", "ref")
RULE_CELL = r"^:?-+:?$"
#: Lines of more characters are read one by one; of shorter ones many are alike.
LONG_LINE = 120


def clean_line(line: Column | str) -> Column:
    """Without marks of formulas, with plain squares and single spaces."""
    text = col(line)
    for mark, plain in (("\\(", ""), ("\\)", ""), ("m^2", "m2"), ("²", "2")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return one_spaced(text)


def cleaned(line: Column) -> Column:
    """``clean_line`` of a line with single spaces already: without marks only squares become plain."""
    marked = F.contains(line, F.lit("\\(")) | F.contains(line, F.lit("\\)")) | F.contains(line, F.lit("m^2"))
    return F.when(marked, clean_line(line)).otherwise(F.replace(line, F.lit("²"), F.lit("2")))


def is_unit(line: Column | str, clean: Column | None = None) -> Column:
    """``clean`` is the line as of ``clean_line``, where a caller has it already; the same below."""
    clean = clean_line(line) if clean is None else clean
    return clean.isin(*UNITS) | clean.rlike(FILTRATION_UNIT) | col(line).isin(*UNITS)


def is_value(line: Column | str, clean: Column | None = None) -> Column:
    """A number, with a per cent sign or none, or a result in words; a unit is none."""
    clean = clean_line(line) if clean is None else clean
    return F.lower(clean).isin(*QUALITATIVE_VALUES) | (clean.rlike(VALUE) & ~is_unit(line, clean))


def is_reference(line: Column | str, clean: Column | None = None) -> Column:
    clean = clean_line(line) if clean is None else clean
    return clean.rlike(REFERENCE) & ~is_unit(line, clean)


def is_no_name(line: Column | str) -> Column:
    line = col(line)
    return line.startswith("(") | (F.contains(line, F.lit(".")) & line.rlike(TITLE)) | line.rlike(NO_NAME)


# --- Tables -----------------------------------------------------------------------------------------------------------


def table_rows(text: Column | str) -> Column:
    """``array<array<string>>`` of the first HTML table with a filled cell, else of Markdown rows, else of lines of three cells or more."""
    text = trimmed(F.coalesce(col(text), F.lit("")))
    lines = F.transform(F.split(text, r"\r?\n"), trimmed)
    cells = lambda line, by: F.transform(F.split(line, by), clean_line)
    rule = lambda row: F.forall(F.filter(row, lambda c: c != ""), lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike(RULE_CELL))
    barred = F.transform(F.filter(lines, lambda x: x.startswith("|")), lambda x: cells(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"))
    markdown = F.filter(barred, lambda row: ~rule(row))
    # A line without any of what parts cells is one cell, and goes before it is cleaned.
    parted = lambda x: F.contains(x, F.lit("\t")) | F.contains(x, F.lit("|")) | x.rlike(r"\s{2}")
    spaced = F.transform(F.filter(lines, lambda x: parted(x) & ~x.startswith("#")), lambda x: F.when(F.contains(x, F.lit("\t")), cells(x, r"\t")).when(F.contains(x, F.lit("|")), cells(x, r"\|")).otherwise(cells(x, r"\s{2,}")))
    filled = F.filter(F.transform(spaced, lambda row: F.filter(row, lambda c: c != "")), lambda row: F.size(row) >= 3)
    html = F.when(F.contains(F.lower(text), F.lit("<table")), F.transform(html_rows(text), lambda row: F.transform(row, cleaned)))
    some = lambda rows: F.when(F.size(rows) > 0, rows)
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    # No line of a text without these is parted.
    parting = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("|")) | text.rlike(r"[^\S\n]{2}")
    return F.coalesce(once(html, some), F.when(bars >= 4, once(markdown, some)), F.when(parting, filled), F.array().cast("array<array<string>>"))


def columns_of(header: Column, width: Column) -> Column:
    """``struct<name, value, unit, ref, status>`` of the columns' places, from 0, and ``told`` whether the first row tells them.

    Each cell in turn is the first kind of column it names that has no place yet. Where the row is no header, the places
    follow from its width.
    """
    none = F.struct(*[F.lit(None).cast("int").alias(c) for c in COLUMNS])

    def step(places: Column, cell: Column) -> Column:
        first = F.coalesce(*[F.when(places[kind].isNull() & cell["c"].rlike(pattern), kind) for kind, pattern in COLUMNS.items()])
        return once(first, lambda told: F.struct(*[F.when(told == kind, cell["i"]).otherwise(places[kind]).alias(kind) for kind in COLUMNS]))

    cells = F.transform(header, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    joined = F.array_join(header, " ")
    looks = joined.rlike("|".join(COLUMNS[c] for c in HEADER_COLUMNS))
    by_width = F.struct(*[F.when(width >= least, F.lit(i)).alias(c) for i, (c, least) in enumerate((("name", 0), ("value", 0)))], F.when(width >= 4, F.lit(2)).alias("unit"), F.when(width >= 4, F.lit(3)).when(width == 3, F.lit(2)).alias("ref"), F.when(width >= 5, F.lit(4)).alias("status"))
    found = F.when(looks, F.aggregate(cells, none, step))
    some = lambda p: F.coalesce(*[p[c] for c in COLUMNS]).isNotNull()
    fields = lambda p, told: F.struct(*[p[c].cast("int").alias(c) for c in COLUMNS], F.lit(told).alias("told"))
    return once(found, lambda p: F.when(some(p), fields(p, True)).otherwise(fields(by_width, False)))


def read_tables(docs: DataFrame, *, id: str, text: str) -> DataFrame:  # noqa: A002
    """``id, row_no, name, value, unit, reference_range, status`` from each document's table, by its columns."""
    # Exploded, so that a table is taken apart once for its rows, its header and its being there.
    rows = docs.select(id, F.explode(F.array(table_rows(text))).alias("_rows")).where(F.size("_rows") > 0).withColumn("_at", columns_of(F.col("_rows")[0], F.size(F.col("_rows")[0])))
    cells = rows.select(id, "_at", F.posexplode("_rows").alias("row_no", "_cells")).where((~F.col("_at.told") | (F.col("row_no") > 0)) & (F.size("_cells") >= 2))
    cell = lambda c: F.coalesce(F.when(F.col(f"_at.{c}") < F.size("_cells"), trimmed(F.col("_cells")[F.col(f"_at.{c}")])), F.lit(""))
    found = cells.select(id, "row_no", cell("name").alias("name"), cell("value").alias("value"), cell("unit").alias("unit"), cell("ref").alias("reference_range"), flag_status(cell("status")).alias("status"))
    return found.where((F.col("name") != "") & ~is_no_name("name") & once(cleaned(F.col("value")), lambda clean: is_value("value", clean)))


# --- Rows over several lines ------------------------------------------------------------------------------------------


def line_groups(text: Column | str) -> Column:
    """``array<struct<line_no, name, value, unit, reference_range>>``: a name, a value, then a unit and a range or either or none, each on a line.

    How many lines a row takes depends on what they hold, so they are folded in order: a line that a row has taken can't
    begin another. ``line_no`` counts lines that aren't blank.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\r?\n"), clean_line), lambda x: x != "")
    # Whether a line is a value is asked of each; what else it is, only where a row may go on with it. A clean line stays
    # as it is, unless taking marks away has put others together.
    told = lambda xs: F.transform(xs, lambda x: once(cleaned(x), lambda clean: F.struct(x.alias("line"), clean.alias("clean"), is_value(x, clean).alias("value"))))
    kind = "array<struct<line_no: int, name: string, value: string, unit: string, reference_range: string>>"
    none = F.array().cast(kind)

    def fold(xs: Column) -> Column:
        at = lambda i: F.get(xs, i)
        has = lambda i, of: F.coalesce(of(at(i)["line"], at(i)["clean"]), F.lit(False))

        def step(s: Column, i: Column) -> Column:
            def taken(unit: Column) -> Column:
                place = F.when(unit, i + 3).otherwise(i + 2)

                def row(ref: Column) -> Column:
                    fields = F.struct(i.alias("line_no"), at(i)["line"].alias("name"), at(i + 1)["line"].alias("value"), F.when(unit, at(i + 2)["line"]).otherwise("").alias("unit"), F.when(ref, at(place)["line"]).otherwise("").alias("reference_range"))
                    return F.struct(F.when(ref, place + 1).otherwise(place).cast("int").alias("next"), F.concat(s["rows"], F.array(fields).cast(kind)).alias("rows"))

                return once(has(place, is_reference), row)

            begins = (i >= s["next"]) & F.coalesce(at(i + 1)["value"], F.lit(False)) & ~has(i, lambda x, clean: is_no_name(x))
            return F.when(begins, once(has(i + 2, is_unit), taken)).otherwise(s)

        start = F.struct(F.lit(0).alias("next"), none.alias("rows"))
        return F.aggregate(F.sequence(F.lit(0), F.size(xs) - 2), start, step, lambda s: s["rows"])

    return once(lines, lambda xs: F.when(F.size(xs) < 2, none).otherwise(once(told(xs), fold)))


def read_line_groups(docs: DataFrame, *, id: str, text: str) -> DataFrame:  # noqa: A002
    """``id, row_no, name, value, unit, reference_range, status`` of rows over several lines; the status isn't known."""
    return docs.select(id, F.explode(line_groups(text)).alias("_r")).select(id, F.col("_r.line_no").alias("row_no"), "_r.name", "_r.value", "_r.unit", "_r.reference_range", F.lit("UNKNOWN").alias("status"))


def read_recognised(docs: DataFrame, *, id: str, text: str) -> DataFrame:  # noqa: A002
    """Rows of tables, or of lines where these are more and the table has less than two; ``source`` tells which."""
    tables, groups = read_tables(docs, id=id, text=text).withColumn("source", F.lit("table")), read_line_groups(docs, id=id, text=text).withColumn("source", F.lit("lines"))
    both = tables.unionByName(groups)
    # Counted in a window, so that each document is read once.
    n = lambda source: F.count_if(F.col("source") == source).over(Window.partitionBy(id))
    counted = both.withColumns({"_t": n("table"), "_l": n("lines")})
    best = F.when((F.col("_t") >= 2) | (F.col("_t") >= F.col("_l")), "table").otherwise("lines")
    return counted.where((F.col("source") == best) & F.col(id).isNotNull()).select(*both.columns)


# --- Two readers ------------------------------------------------------------------------------------------------------


def reading_quality(docs: DataFrame, rows: DataFrame, *, id: str, text: str, least_rows: int = 3, least_letters: int = 500, ratio: float = 0.5) -> DataFrame:  # noqa: A002
    """``id, n_rows, n_lines, sufficient`` for each document: whether ``rows`` hold enough of its lines that look like results.

    Three rows are enough, unless eight lines or more look like results and the rows are less than half of them. A long
    text may have fewer: one row, or of five such lines or more two and half of them.
    """
    looks = lambda x: (F.length(x) >= 5) & (fits(x, "tabular", "qualitative", "descriptive", "categorical"))
    # Exploded, so that the patterns run compiled, and once for lines that are alike.
    lines = read_alike(explode_lines(docs.select(id, text), id=id, text=text), lambda rows, line: rows.where(looks(trimmed(line))), line="line", longest=LONG_LINE)
    lines = lines.groupBy(id).agg(F.count("*").alias("n_lines"))
    counts = rows.groupBy(id).agg(F.count("*").alias("n_rows"))
    told = docs.select(id, F.length(F.coalesce(text, F.lit(""))).alias("_letters")).join(lines, id, "left").join(counts, id, "left").na.fill(0, ["n_rows", "n_lines"])
    n, lines_ = F.col("n_rows"), F.col("n_lines")
    many = (n >= least_rows) & ~((lines_ >= 8) & (n < lines_ * ratio))
    few = (n < least_rows) & (F.col("_letters") >= least_letters) & (n >= 1) & ~((lines_ >= 5) & (n < F.greatest(F.lit(2), lines_ * ratio)))
    return told.select(id, "n_rows", "n_lines", (many | few).alias("sufficient"))


def hybrid_rows(docs: DataFrame, first: DataFrame, second: Callable[[DataFrame], DataFrame], *, id: str, text: str, keys: list[Column]) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """The rows of two readers, and ``id, n_rows, n_lines, sufficient, n_added, reader`` for each document.

    Args:
        first: what the cheap reader has found in all documents.
        second: reads a table of documents; it is given those alone that the first hasn't read well enough. Its rows have
            the columns of ``first``.
        keys: what makes rows of one document the same; a second reader's row that is there already isn't added.

    What the first reader has found, and how well, is written to a table each, as both are read more than once.
    """
    first = materialize(first, "first-rows")
    quality = materialize(reading_quality(docs, first, id=id, text=text), "reading-quality")
    others = second(docs.join(quality.where("NOT sufficient"), id, "left_semi"))
    both = first.withColumn("_reader", F.lit(0)).unionByName(others.withColumn("_reader", F.lit(1)))
    named = both.withColumns({f"_k{i}": F.coalesce(k, F.lit("")) for i, k in enumerate(keys)})
    at = [id, *[f"_k{i}" for i in range(len(keys))]]
    # All rows of the first reader stay; of the second's, the first of those that the other lacks.
    known = named.where("_reader = 0").select(*at).distinct()
    added = first_occurrence(named.where("_reader = 1").join(known, at, "left_anti"), keys=at, order=[c for c in others.columns if c != id])
    rows = named.where("_reader = 0").unionByName(added)
    n_added = added.groupBy(id).agg(F.count("*").alias("n_added"))
    told = quality.join(n_added, id, "left").na.fill(0, ["n_added"])
    reader = F.when((F.col("n_added") > 0) & (F.col("n_rows") > 0), "both").when(F.col("n_added") > 0, "second").otherwise("first")
    return rows.drop("_reader", *at[1:]), told.withColumn("reader", reader)

"""Line-oriented reports: sections, boilerplate, repeated headers, redaction, and rows of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import BOILERPLATE_HEADING, is_boilerplate, redact_line, trimmed
from tarnwork.operators.catalog import rules_by_printed_unit
from tarnwork.operators.context import serum_or_urine
from tarnwork.operators.resolve import resolve_names
from tarnwork.operators.row_grammars import NUMERIC_GRAMMARS, TABULAR_GRAMMARS, continued, parse_rows, section_end, section_header
from tarnwork.session import materialize


#: Slots that hashes of words fall into: a bound for the table that tells which are asked for.
TOKEN_SLOTS = 1 << 16


def explode_lines(docs: DataFrame, *, id: str, text: str) -> DataFrame:  # noqa: A002
    """``id, line_no, line`` from 0."""
    return docs.select(id, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def carry_section(lines: DataFrame, *, partition: list[str], order: list[str], header: Column, ends: Column) -> DataFrame:
    """``lines`` with ``section``: the last header's, until an end clears it."""
    tag = F.when(header.isNotNull(), header).when(ends, F.lit("__END__"))
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.nullif(F.last(tag, ignorenulls=True).over(before), F.lit("__END__")))


def flag_from(lines: DataFrame, *, partition: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """``lines`` with a flag that stays true from the first row that ``starts`` on."""
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.max(F.coalesce(starts, F.lit(False))).over(before))


def join_continuations(lines: DataFrame, *, partition: list[str], order: list[str], line: str, continues: Column) -> DataFrame:
    """A line takes in the next one where ``continues`` holds for it (with ``next_line``); the next one goes."""
    by = Window.partitionBy(*partition).orderBy(*order)
    seen = lines.withColumn("next_line", F.lead(line).over(by))
    seen = seen.withColumn("_takes", F.coalesce(continues, F.lit(False)))
    seen = seen.withColumn("_taken", F.coalesce(F.lag("_takes").over(by), F.lit(False)))
    joined = F.when(F.col("_takes"), F.concat_ws(" ", line, "next_line")).otherwise(F.col(line))
    return seen.where(~F.col("_taken")).withColumn(line, joined).drop("next_line", "_takes", "_taken")


def repeated_lines(lines: DataFrame, *, doc: list[str], page: str, pos: str, line: str, least: int = 20, top: int = 12, bottom: int = 6) -> DataFrame:
    """``doc, line`` of what stands on two or more pages: long lines anywhere, others at one place of a margin."""
    seen = _line_places(lines, doc=doc, page=page, pos=pos, line=line, least=least, top=top, bottom=bottom)
    return seen.where("repeated").select(*doc, "line")


def _line_places(lines: DataFrame, *, doc: list[str], page: str, pos: str, line: str, least: int, top: int, bottom: int) -> DataFrame:
    """``doc, line, repeated`` and ``first``, the smallest page (none, if one has no number), of each distinct line."""
    by_page = Window.partitionBy(*doc, page)
    at, n = F.row_number().over(by_page.orderBy(pos)), F.count("*").over(by_page)
    rows = lines.select(*doc, F.col(page).alias("_page"), F.col(line).alias("line"), at.alias("_top"), n.alias("_n")).withColumn("_bottom", (F.col("_n") - F.col("_top") + 1).cast("int"))
    zone = lambda name, place: F.struct(F.lit(name).alias("zone"), place.alias("at"))
    zones = F.filter(F.array(F.when(F.length("line") >= least, zone("", F.lit(0))), F.when(F.col("_top") <= top, zone("top", F.col("_top"))), F.when(F.col("_bottom") <= bottom, zone("bottom", F.col("_bottom")))), lambda z: z.isNotNull())
    # On two pages or more: the smallest isn't the greatest, which partial sums tell, by hashing and without a list of all.
    placed = rows.select(*doc, "line", "_page", F.explode_outer(zones).alias("_zone")).groupBy(*doc, "line", "_zone")
    placed = placed.agg(F.min("_page").alias("_first"), F.max("_page").alias("_last"), F.bool_or(F.col("_page").isNull()).alias("_bare"))
    several = F.bool_or(F.coalesce(F.col("_zone").isNotNull() & (F.col("_first") < F.col("_last")), F.lit(False)))
    return placed.groupBy(*doc, "line").agg(several.alias("repeated"), F.when(~F.bool_or("_bare"), F.min("_first")).alias("first"))


def prepare_text(lines: DataFrame, *, doc: list[str], page: str, pos: str, line: str, keep: Column | None = None, known: Column | None = None) -> DataFrame:
    """Lines to show: redacted (names in the array ``known`` too), without boilerplate and what follows its headings, and repeated ones once.

    Lines for which ``keep`` holds are never dropped.
    """
    kept = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)
    # A page's own repeats are counted there; which page is the first is told by line, so that no common line is a group of rows.
    nth = F.row_number().over(Window.partitionBy(*doc, page, line).orderBy(pos))
    rows = lines.withColumn("_keep", kept).withColumn("_nth", nth)
    rows = flag_from(rows, partition=[*doc, page], order=[pos], starts=F.col(line).rlike(BOILERPLATE_HEADING), name="_legal")
    # What goes in any case doesn't meet the repeated lines.
    rows = rows.where(~(is_boilerplate(line) | F.col("_legal")) | F.col("_keep"))
    places = _line_places(lines, doc=doc, page=page, pos=pos, line=line, least=20, top=12, bottom=6)
    rows = rows.join(places.where("repeated").withColumnRenamed("line", line), [*doc, line], "left")
    again = F.coalesce("repeated", F.lit(False)) & (~F.col("first").eqNullSafe(F.col(page)) | (F.col("_nth") > 1))
    return rows.where(~again | F.col("_keep")).withColumn(line, redact_line(line, known)).select(*lines.columns)


def distinct_rows(rows: DataFrame, *, doc: list[str], order: list[str], section: str = "section") -> DataFrame:
    """Of rows of one document with equal name, section and value, the first."""
    at = F.row_number().over(Window.partitionBy(*doc, F.lower("raw_name"), F.coalesce(section, F.lit("")), "value").orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def parse_report(docs: DataFrame, *, id: str, text: str, catalog: DataFrame | None = None, rules: DataFrame | None = None, defaults: DataFrame | None = None, limits: DataFrame | None = None, units: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:  # noqa: A002
    """Typed rows from whole reports: lines, sections, continuations, grammars, first occurrences, and what the catalog says.

    Args:
        catalog: ``name, display_name, aliases`` of tests, to which names are resolved within their section; then an
            analyte is told from another by its value, by ``limits(name, normal_max)``.
        rules, defaults, units: as of ``rules_by_printed_unit``, for values whose printed range tells nothing.
        patterns: as of ``parse_rows``, for lines that no grammar fits.

    A line that no grammar fits takes in the next one where both together do; the next one is read by itself as well.
    """
    lines = explode_lines(docs.select(id, text), id=id, text=text).withColumn("line", trimmed("line"))
    by = Window.partitionBy(id).orderBy("line_no")
    lines = lines.withColumn("_next", F.lead("line").over(by)).where(F.length("line") >= 3)
    lines = lines.withColumn("line", continued("line", "_next")).drop("_next")
    # A column of its own, so that a heading's patterns run once.
    lines = lines.withColumn("_header", section_header("line"))
    header = F.col("_header")
    tagged = carry_section(lines, partition=[id], order=["line_no"], header=header, ends=section_end("line")).where(header.isNull()).drop("_header")
    rows = distinct_rows(parse_rows(tagged, line="line", patterns=patterns), doc=[id], order=["line_no"])
    if catalog is None:
        return rows
    # Names are asked for once each and then told to all rows, so the rows are read twice, but parsed once.
    rows = materialize(rows, "parsed-rows")
    rows = resolve_names(rows, catalog, key=[id, "line_no"], printed="raw_name", context="section", unit="unit", value="value").withColumn("test", F.coalesce("pattern_test", "test"))
    shown = catalog.groupBy(F.col("name").alias("_name")).agg(F.min("display_name").alias("_shown"))
    if limits is not None:
        rows = serum_or_urine(rows.withColumn("_range", F.col("reference_range")), catalog, limits, test="test", value="value", printed="_range").drop("_range")
    if rules is not None and defaults is not None:
        numeric = F.col("grammar").isin(*NUMERIC_GRAMMARS, "pattern")
        told = rules_by_printed_unit(rows.withColumnRenamed("status", "_printed"), rules, defaults, units=units)
        rows = told.withColumn("status", F.when((F.col("_printed") == "UNKNOWN") & numeric & F.col("test").isNotNull(), F.col("status")).otherwise(F.col("_printed"))).drop("_printed")
    sure = F.when(F.col("grammar") == "pattern", F.col("confidence")).when(F.col("test").isNull(), F.col("confidence")).when(F.col("grammar").isin(*TABULAR_GRAMMARS), F.lit(0.9)).otherwise(F.lit(0.85))
    told = rows.join(shown, F.col("test") == F.col("_name"), "left")
    return told.select(*[c for c in rows.columns if c not in ("confidence", "test", "pattern_test")], "test", F.coalesce("_shown", "raw_name").alias("display_name"), sure.alias("confidence"))


def locate_rows(rows: DataFrame, lines: DataFrame, *, doc: str, id: str, name: str, value: str, recorded: DataFrame | None = None) -> DataFrame:  # noqa: A002
    """``rows`` with ``line_no``: where each was printed among ``lines({doc}, line_no, line)``; null where it isn't found.

    That is the line ``recorded({id}, line_no)`` for it, if the document has it; else the first line that holds the value
    by itself and the first word of the name, of three letters or more. Lines are looked up by a word or sign of the value
    among their own, so rows meet only lines of their document that have it.

    Rows and lines are joined by sorting: tables written in between are small as files however many rows they hold, so
    Spark's estimates would have them broadcast, and the driver would hold them whole.
    """
    signs = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tokens = lambda text: F.array_distinct(F.concat(signs(text, r"(?U)\w+"), signs(text, r"(?U)[^\w\s]")))
    slot = lambda token: F.pmod(F.xxhash64(token), F.lit(TOKEN_SLOTS))
    own, word = trimmed(F.lower(F.coalesce(value, F.lit("")))), F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), "[a-z]{3,}", 0)
    first = F.coalesce(*[F.nullif(F.regexp_extract(own, p, 0), F.lit("")) for p in (r"(?U)\w+", r"(?U)[^\w\s]")])
    asked = rows.select(F.col(id).alias("_id"), F.col(doc).alias("_of"), own.alias("_own"), word.alias("_word"), first.alias("_first")).where("_own <> '' AND _word <> ''")
    low = F.lower(F.col("line"))
    postings = lines.select(F.col(doc).alias("_doc"), F.col("line_no").alias("_no"), low.alias("_line"), F.explode(tokens(low)).alias("_token"))
    # What no row asks for isn't dealt out; the slots are few, however many words there are.
    postings = postings.join(F.broadcast(asked.select(slot(F.col("_first")).alias("_slot")).distinct()), slot(F.col("_token")) == F.col("_slot"), "left_semi")
    alone = F.concat(F.lit(r"(?U)(?<![\w.])\Q"), F.replace(F.col("_own"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    hits = asked.hint("merge").join(postings, (F.col("_of") == F.col("_doc")) & (F.col("_first") == F.col("_token"))).where(F.contains("_line", F.col("_word")) & F.rlike("_line", alone))
    found = hits.groupBy("_id").agg(F.min("_no").alias("_found"))
    told = rows.join(found.hint("merge"), F.col(id) == F.col("_id"), "left")
    if recorded is None:
        return told.select(*rows.columns, F.col("_found").alias("line_no"))
    ends = lines.groupBy(F.col(doc).alias("_doc")).agg(F.max("line_no").alias("_last"))
    noted = recorded.groupBy(F.col(id).alias("_noted_id")).agg(F.min("line_no").alias("_noted"))
    told = told.join(noted.hint("merge"), F.col(id) == F.col("_noted_id"), "left").join(ends.hint("merge"), F.col(doc) == F.col("_doc"), "left")
    return told.select(*rows.columns, F.coalesce(F.when(F.col("_noted").between(0, F.col("_last")), F.col("_noted")), "_found").alias("line_no"))

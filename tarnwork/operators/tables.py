"""Tables inside text: HTML, Markdown and TSV rows, and JSON in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import col, once, one_spaced


def _plain(cell: Column) -> Column:
    # What marks and entities begin with is looked for first: most cells have neither.
    text = F.when(F.contains(cell, F.lit("<")), F.regexp_replace(cell, r"(?is)<[^>]*>", " ")).otherwise(cell)

    def decoded(text: Column) -> Column:
        plain = text
        for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(entity), F.lit(character))
        return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)

    return one_spaced(once(text, decoded))


def html_rows(html: Column | str) -> Column:
    """``array<array<string>>``: the rows with a filled cell of the first table that has any; one that isn't closed counts."""
    tables = F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(r"(?is)<table\b[^>]*>(.*?)(?:</table>|\z)"), F.lit(1))
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), _plain)
    rows = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), cells), lambda r: F.exists(r, lambda c: c != ""))
    return F.coalesce(F.get(F.filter(F.transform(tables, rows), lambda t: F.size(t) > 0), F.lit(0)), F.array().cast("array<array<string>>"))


def html_items(html: Column | str, tag: str) -> Column:
    """The plain text of each element of a kind that doesn't nest."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), _plain)


def text_cells(line: Column | str) -> Column:
    """The cells of a line: by bars, else tabs, else two spaces; null where it is one cell or a rule of dashes."""
    line = col(line)
    bars = F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|")
    cells = F.when(F.contains(line, F.lit("|")), bars).when(F.contains(line, F.lit("\t")), F.split(line, r"\t+")).otherwise(F.split(F.trim(line), r" {2,}"))
    tidy = F.transform(cells, one_spaced)
    return F.when((F.size(tidy) > 1) & ~F.forall(tidy, lambda c: c.rlike(r"^:?-*:?$")), tidy)


def column_of(header: Column | str, pattern: str) -> Column:
    """The place of the first cell that matches, from 0; null if none does."""
    at = F.array_position(F.transform(col(header), lambda c: c.rlike(pattern)), True)
    return F.when(at > 0, at - 1)


def json_in_text(text: Column | str, schema: str) -> Column:
    """The JSON object or array in a reply, without fences and words around it; null if there is none."""
    plain = F.regexp_replace(col(text), r"```(?:json)?", "")
    opening, closing = (r"\[", r"\]") if schema.lower().startswith("array") else (r"\{", r"\}")
    return F.from_json(F.regexp_extract(plain, rf"(?s)({opening}.*{closing})", 1), schema)


def explode_table(pages: DataFrame, *, id: str, html: str) -> DataFrame:  # noqa: A002
    """``id, row_no, cells``."""
    return pages.select(id, F.posexplode(html_rows(html)).alias("row_no", "cells"))

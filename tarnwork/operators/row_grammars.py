"""Rows of results in lines of text: what is noise, what is a label, and the grammars that rows are written in.

A line is tried by one grammar after the other, and the first whose label is plausible gives the row. Each grammar is one
pattern, run once; a line of another kind costs a search for a digit or a word at most. Further patterns come as rows of
a table, tried by priority after the grammars.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.numbers import pattern_confidence
from tarnwork.functions.status import PRINTED_RANGE, qualitative_status, range_status
from tarnwork.functions.text import col, has_any, once, trimmed
from tarnwork.session import materialize

# Units as reports print them, results in words of rows without numbers, and descriptive results.
UNITS = (
    "mL/min/1.73m²", "mL/min/1.73m2", "mL/min/1.73 m2", "mL/min", "min(1.73m)", "cells/µL", "cells/μL", "cells/mm3", "Million/cu.mm",
    "cells/cu.mm", "mill/cumm", "mil/µL", "mil/μL", "thou/µL", "thou/μL", "/c.mm", "cumm", "CV%", "thou/cu.mm", "mill/cu.mm", "/cu.mm",
    "thou/mm3", "mill/mm3", "K/µL", "K/μL", "µIU/mL", "μIU/mL", "mIU/mL", "IU/mL", "AU/mL", "kUA/L", "ng/mL", "ng/dL", "pg/mL", "nmol/L",
    "µmol/L", "μmol/L", "mmol/L", "µg/dL", "μg/dL", "µg/L", "μg/L", "ug/L", "mg/dL", "gm/dL", "g/dL", "g/mL", "mg/L", "g/L", "mg/day", "U/L",
    "IU/L", "mIU/L", "mEq/L", "meq/L", "/µL", "/μL", "/uL", "/hpf", "/HPF", "mm/hr", "ratio", "Index", "fL", "sec", "pg", "ug/dL", "%",
)
WORD_RESULTS = (
    "Moderate Positive", "Strong Positive", "Weak Positive", "Not Detected", "Non Reactive", "Non-Reactive", "Indeterminate", "Equivocal",
    "Negative", "Positive", "Reactive", "Detected", "Absent", "Present", "Trace", "Nil",
)
DESCRIPTIONS = ("None Seen", "Not Seen", "Semi Fluid", "Semi Solid", "Dark Brown", "Light Brown", "Brown", "Alkaline", "Acidic")
#: Results in words, as cells hold them.
QUALITATIVE_VALUES = (
    "negative", "positive", "not detected", "detected", "absent", "present", "reactive", "non reactive", "non-reactive", "moderate positive",
    "weak positive", "strong positive", "nil", "trace", "equivocal", "indeterminate", "none seen", "semi fluid", "semi solid", "dark brown",
    "brown", "alkaline", "acidic",
)
#: Words that end lines of prose, not results.
NOT_RESULTS = (
    "disease", "disorder", "disorders", "symptoms", "syndrome", "infection", "infections", "allergens", "allergen", "test", "collection",
    "centre", "center", "haematology", "hematology", "edta", "report", "lab", "calculated", "immunology", "immunogenetics", "serology",
    "microbiology", "transplant", "category", "ratio", "index", "reactivity", "present",
)


def alternatives(words: tuple[str, ...], space: str = r"\s+") -> str:
    """The longest first; ``space`` is what stands for a space."""
    quoted = (re.sub(r"([^\w\s])", r"\\\1", w).replace(" ", space) for w in sorted(words, key=len, reverse=True))
    return f"(?:{'|'.join(quoted)})"


NUMBER = r"(?:[<>]=?\s*)?-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
UNIT, WORD_RESULT, DESCRIPTION = alternatives(UNITS, " "), alternatives(WORD_RESULTS), alternatives(DESCRIPTIONS)
ANY_CASE = "(?iu)"

# The forms of rows. Groups are numbered; see GRAMMARS.
VALUE_RANGE_UNIT = rf"{ANY_CASE}^(.*?)({NUMBER})\s+(?:(?:High|Low|Normal|Abnormal)\s+)?({NUMBER}\s*[-–]\s*{NUMBER})\s+({UNIT})\s*$"
TABULAR = rf"{ANY_CASE}^(.+?)\s+({NUMBER})\s+({UNIT})\s*(.*?)$"
RIGHT_ANCHORED = rf"{ANY_CASE}^(.*?)({NUMBER})\s+({UNIT})(?:\s+(.*))?$"
QUALITATIVE = rf"{ANY_CASE}^(.+?)\s+({WORD_RESULT})\s*(?:({UNIT})\s+)?(.*?)$"
DESCRIPTIVE = rf"{ANY_CASE}^(.+?)\s+({DESCRIPTION})\s+(?:({UNIT})\s+)?(.*?)$"
CATEGORICAL = rf"{ANY_CASE}^(.+?(?:Group|Factor|Typing|Blood Type))\s+(A|B|AB|O|Positive|Negative|Reactive|Non-Reactive)\s*$"
UNITLESS = rf"{ANY_CASE}^(.+?)\s+({NUMBER})\s+(\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?.*)$"
SIMPLE = rf"{ANY_CASE}^(.{{1,40}}?)\s+({NUMBER})$"
TEXT_PAIR = rf"{ANY_CASE}^(.{{2,55}}?)\s+([A-Za-z][A-Za-z0-9\-]{{0,30}})$"

TABULAR_GRAMMARS = ("value_range_unit", "tabular", "right_anchored")
NUMERIC_GRAMMARS = (*TABULAR_GRAMMARS, "unitless", "simple")
#: Name, pattern, the groups of label, value, unit and range (0: none), and what a line needs for a try.
GRAMMARS = (
    ("value_range_unit", VALUE_RANGE_UNIT, (1, 2, 4, 3), rf"{ANY_CASE}\d\s+{UNIT}\s*$"),
    ("tabular", TABULAR, (1, 2, 3, 4), rf"{ANY_CASE}\d\s+{UNIT}"),
    ("right_anchored", RIGHT_ANCHORED, (1, 2, 3, 4), rf"{ANY_CASE}\d\s+{UNIT}"),
    ("qualitative", QUALITATIVE, (1, 2, 3, 4), rf"(?i)\s{WORD_RESULT}"),
    ("descriptive", DESCRIPTIVE, (1, 2, 3, 4), rf"(?i)\s{DESCRIPTION}\s"),
    ("categorical", CATEGORICAL, (1, 2, 0, 0), r"(?i)group|factor|typing|blood type"),
    ("unitless", UNITLESS, (1, 2, 0, 3), rf"\s{NUMBER}\s+\d"),
    ("simple", SIMPLE, (1, 2, 0, 0), rf"\s{NUMBER}$"),
    ("text_pair", TEXT_PAIR, (1, 2, 0, 0), r"(?i)[a-z0-9-]$"),
)

_BY_KIND = {kind: (pattern, needs) for kind, pattern, _, needs in GRAMMARS}

# Lines that are no rows, whatever their letters' case, and in the case as it is.
NOISE = (
    r"^\s*Page\s+\d+\s+(?:of|/)\s+\d+", r"^\s*Name\s*:", r"^\s*Patient\s+Name\b", r"^\s*Age\s*(?:/|:|\s+Gender)\b", r"^\s*Gender\s*:",
    r"^\s*(?:UHID|MR\s+No|Visit\s+ID|IP/OP)\b", r"^\s*(?:Ref\s+Doctor|Ref\s+By|Client\s+Name|Patient\s+location)\b", r"^\s*DEPARTMENT\s+OF\b",
    r"^\s*(?:\*+\s*)?End Of Report", r"^\s*(?:SIN|SID|Acc(?:ession)?|Lab|Sample)\s*(?:No\.?|ID|#)\s*:", r"^\s*Lab\s+No", r"^\s*Collected\s*(?:at|:)",
    r"^\s*A/c\s+Status", r"^\s*(?:National|Block|ROHINI|DELHI|Sector)\s", r"^\s*Test\s+(?:Report|Name)", r"^\s*(?:Note|Interpretation|Important|Please|If\s+Test)\b",
    r"^\s*Dr\s+", r"\b(?:mr|mrs|ms|miss)\.\s*[a-z]", r"^\s*MD,", r"^\s*Tel:", r"^\s*If\s+", r"^\s*This\s+is\s+", r"^\s*Report\s+Status", r"^\s*\d+\.\s+",
    r"within\s+\d+\s+(?:hours|days)", r"^\s*(?:Differential|Absolute)\s+", r"^\s*\(", r"^\s*(?:Treatment|Guidelines|Guideline)", r"^\s*Reported\s*:",
    r"^\s*(?:Consultant|Technical|Senior|Deputy|Research)\s", r"\bHOD\b", r"Courts/Forum", r"^\s*NRL\s+-",
)
NOISE_AS_IT_IS = (r"^\s*\*\w+\*\s*$", r"^\s*\.+\s*$", r"^\s*-{5,}", r"^\s*\|", r"^[A-Z]{10,}$", r"^[HP]{10,}$", r"^\s*Ÿ", r"^\s*·")
# Those at the start of a line are one pattern, so that they aren't tried at every place of it.
_BEGINS = r"^\s*"
NOISE_AT_START = f"(?i){_BEGINS}(?:{'|'.join(n.removeprefix(_BEGINS) for n in NOISE if n.startswith(_BEGINS))})"
#: The others, each with what a line, in lower case, can't lack.
NOISE_ANYWHERE = {r"\b(?:mr|mrs|ms|miss)\.\s*[a-z]": ".", r"within\s+\d+\s+(?:hours|days)": "within", r"\bHOD\b": "hod", r"Courts/Forum": "courts/forum"}
ODD_LINES = f"^(?:{'|'.join(n.removeprefix('^') for n in NOISE_AS_IT_IS)})"
COUNT_HEADING = r"(?i)^\s*(?:Differential|Absolute)\s+"
# Headings of sections, what ends a section, and how labels of prose and of other fields are told.
SECTION_HEADERS = {
    "urine": r"(?i)protein\s*[-–]\s*creatinine\s*ratio,\s*urine|urine\s+routine|urine\s+analysis|urine\s+examination|urinalysis|routine\s+urine|urine\s+creatinine",
    "dlc": r"(?i)differential\s+leucocyt(?:e|ic)\s+count|differential\s+leukocyt(?:e|ic)\s+count|dlc\s*\(differential",
    "alc": r"(?i)absolute\s+leucocyt(?:e|ic)\s+count|absolute\s+leukocyt(?:e|ic)\s+count|alc\s*\(absolute",
}
SECTION_END = (
    r"(?i)\b(?:serum|plasma|edta|whole\s+blood|ha?emogram|complete\s+blood\s+count|cbc|lipid\s+profile|liver\s+function|kidney\s+function"
    r"|renal\s+function|thyroid\s+(?:profile|function)|ha?ematology|biochemistry|panel|profile)\b"
)
# Words of prose and of other fields are one pattern, so that a word's beginning is looked for once.
OTHER_WORDS = (
    r"\b(?:collection cent(?:re|er)|reference lab(?:oratory)?|ph\.?d|m\.?d|that|which|are|were|with|have|has|had|patient|cases|similar|clinical|affected"
    r"|define|development|factors|organs|commentary|bacteria|levels|may|organism|volume of|(?:in|on|of|to|from|for) the)\b"
)
OTHER_FIELDS = (
    "page", "note", "collected", "reported", "lab no", "name", "ref by", "ref doctor", "a/c", "national", "block", "important", "interpretation",
    "advised", "disclaimer", "department of", "visit id", "client name", "patient location", "patient name", "uhid",
)
SPECIMENS = ("serum", "urine", "plasma", "csf", "edta", "blood")
SPECIMEN_LABEL = r"\b(?:type of sample|sample type|specimen type|specimen)\b"
NOT_PAIRED = ("iv", "im", "po", "sc", "collection", "centre", "center", "test")


def fits(line: Column, *kinds: str) -> Column:
    """One of the grammars' patterns fits the line; what a pattern needs is looked for first."""
    found = F.lit(False)
    for kind in kinds:
        pattern, needs = _BY_KIND[kind]
        found = found | (line.rlike(needs) & line.rlike(pattern))
    return found


def is_noise(line: Column | str) -> Column:
    """Not a row: fields of the report's head and foot, notes, people; count headings that hold a result are none."""
    line = col(line)
    anywhere = (F.contains(F.lower(line), F.lit(needs)) & line.rlike(f"(?i){pattern}") for pattern, needs in NOISE_ANYWHERE.items())
    noise = reduce(lambda a, b: a | b, anywhere, line.rlike(NOISE_AT_START) | line.rlike(ODD_LINES))
    return noise & ~(line.rlike(COUNT_HEADING) & (fits(line, "tabular") | has_right_anchored(line)))


def has_right_anchored(line: Column) -> Column:
    """A number and a unit, with something before them."""
    return line.rlike(_BY_KIND["right_anchored"][1]) & (F.length(trimmed(F.regexp_extract(line, RIGHT_ANCHORED, 1))) > 0)


def plausible_label(name: Column | str, value: Column | str | None = None) -> Column:
    """Whether a text can name a test: short, without a colon, a full stop at its end or a comma inside, and not prose.

    ``value`` is the word of a text pair: specimens belong to labels of specimens alone, and words that end lines of prose are no results.
    """
    name = col(name)
    low = F.lower(name)
    # Eleven words take 21 characters.
    fits = (F.length(name) >= 2) & (F.length(name) <= 70) & ((F.length(name) < 21) | (F.size(F.split(trimmed(name), r"(?U)\s+")) <= 10))
    other = name.rlike(r"^\d+$|:|\.$|,\S") | low.rlike(rf"^(?:{'|'.join(OTHER_FIELDS)}|head )") | low.rlike(OTHER_WORDS)
    if value is None:
        return fits & ~other
    word = F.lower(col(value))
    heading = low.rlike(r"^[a-z\s,]+$") | ((F.length(name) > 12) & (F.upper(name) == name))
    specimen = word.isin(*SPECIMENS) & ~low.rlike(SPECIMEN_LABEL) & heading
    return fits & ~other & ~specimen & ~word.isin(*NOT_PAIRED) & ~word.isin(*NOT_RESULTS)


def holds_unit(name: Column) -> Column:
    """A known unit occurs anywhere in the text, in whatever case."""
    # A unit that holds another is there only if that is.
    known = dict.fromkeys(u.lower() for u in UNITS)
    least = [u for u in known if not any(v != u and v in u for v in known)]
    return has_any(F.lower(name), tuple(least))


def section_header(line: Column | str) -> Column:
    """The section that a heading begins, else null."""
    found = F.lit(None).cast("string")
    for section, pattern in reversed(SECTION_HEADERS.items()):
        found = F.when(col(line).rlike(pattern), section).otherwise(found)
    return found


def section_end(line: Column | str) -> Column:
    """A heading of a blood panel, of at most eight words and without a number, ends a section."""
    line = col(line)
    return line.rlike(SECTION_END) & ~line.rlike(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])") & (F.size(F.split(trimmed(line), r"(?U)\s+")) <= 8)


def continued(line: Column | str, following: Column | str) -> Column:
    """``line`` with the following one, where it is no row by itself, the next isn't either, and both together are one."""
    line, following = col(line), col(following)
    row = lambda c: fits(c, "tabular", "qualitative", "descriptive", "categorical", "unitless") | has_right_anchored(c)
    own = following.rlike("^[A-Za-z]") & (row(following) | fits(following, "simple", "text_pair"))
    both = F.concat_ws(" ", line, following)
    joins = (F.length(F.coalesce(following, F.lit(""))) > 0) & ~row(line) & ~own & fits(both, "tabular", "qualitative")
    return F.when(joins, both).otherwise(line)


_MARK = "\x01"


def _row(text: Column, grammar: tuple) -> Column:
    """A struct of the grammar's fields, with a null label where that isn't plausible; null where the pattern doesn't fit."""
    kind, pattern, groups, needs = grammar
    # One run of the pattern: its groups between marks; a line that doesn't fit has no mark.
    marked = F.regexp_replace(text, pattern, _MARK + _MARK.join(f"${g}" if g else "" for g in groups))

    def fields(p: Column) -> Column:
        # Trimmed once, however often the label is looked at.
        return F.when(F.size(p) == 5, once(F.transform(p, trimmed), told))

    def told(p: Column) -> Column:
        name, value = p[1], p[2]
        good = plausible_label(name, value) if kind == "text_pair" else plausible_label(name)
        if kind == "simple":
            good = good & ~holds_unit(name)
        if kind == "text_pair":
            good = good & ~name.rlike(r",$|;") & ~F.lower(value).isin(*QUALITATIVE_VALUES)
        made = F.struct(F.lit(kind).alias("grammar"), F.when(good, name).alias("raw_name"), value.alias("value"), p[3].alias("unit"), p[4].alias("reference_range"))
        return F.when(name != "", made)

    made = once(F.split(marked, _MARK), fields)
    return made if needs == _BY_KIND["tabular"][1] else F.when(text.rlike(needs), made)


def _labelled(row: Column) -> Column:
    return F.when(row["raw_name"].isNotNull(), row)


def pattern_rows(patterns: DataFrame, most: int = 5_000) -> list[dict]:
    """The active ones of ``patterns(test, pattern_name, regex_pattern, priority, value_group, unit_group, range_group, is_active)``, as they are tried.

    By test, then the highest priority first, then by name. Named groups are written as Java does; patterns that don't
    compile are left out. A table of more than ``most`` raises ValueError: each pattern is an expression of the plan.
    """
    rows = patterns.where("is_active").orderBy("test", F.desc("priority"), "pattern_name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    compile_, out = patterns.sparkSession._jvm.java.util.regex.Pattern, []
    for r in rows:
        written = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<(\w+)>", r"(?<\1>", r.regex_pattern))
        written = re.sub(r"(?<=\(\?<)\w+(?=>)|(?<=\\k<)\w+(?=>)", lambda m: m[0].replace("_", "0"), written)
        try:
            groups = compile_.compile(written).matcher("").groupCount()
        except Exception:  # noqa: BLE001  the table's pattern is at fault, and the others go on
            continue
        out.append({**r.asDict(), "written": written, "groups": groups})
    return out


def tail_range(tail: Column) -> Column:
    """The range, else the limit, in what follows a match; blank without either."""
    part = lambda pattern, group: F.regexp_extract(tail, pattern, group)
    limit = r"([<>])\s*(\d+\.?\d*)"
    both = F.concat(part(PRINTED_RANGE, 1), F.lit(" - "), part(PRINTED_RANGE, 2))
    return F.when(part(PRINTED_RANGE, 1) != "", both).otherwise(F.concat(part(limit, 1), part(limit, 2)))


def _by_pattern(text: Column, p: dict) -> Column:
    """As ``_row``, with the pattern's test and confidence."""
    groups = p["groups"]
    # The whole line around the first match: what precedes, the groups, what follows.
    marked = F.regexp_replace(text, rf"{ANY_CASE}^.*?(?:{p['written']})(.*)$", _MARK + _MARK.join(f"${g}" for g in range(1, groups + 2)))
    at = lambda parts, g: parts[g] if g and 0 < g <= groups else F.lit("")

    def fields(parts: Column) -> Column:
        ranged = at(parts, p["range_group"])
        filled = sum((F.when(parts[g] != "", 1).otherwise(0) for g in range(1, groups + 1)), F.lit(0))
        made = F.struct(
            F.lit("pattern").alias("grammar"), trimmed(at(parts, 1)).alias("raw_name"), at(parts, p["value_group"]).alias("value"),
            F.when(trimmed(at(parts, p["unit_group"])) == "", "N/A").otherwise(trimmed(at(parts, p["unit_group"]))).alias("unit"),
            F.when(ranged != "", ranged).otherwise(tail_range(trimmed(parts[groups + 1]))).alias("reference_range"),
            F.lit(p["test"]).alias("pattern_test"), pattern_confidence(F.lit(p["priority"]), filled).alias("pattern_confidence"),
        )
        return F.when((F.size(parts) == groups + 2) & (at(parts, p["value_group"]) != ""), made)

    return once(F.split(marked, _MARK), fields)


def parse_rows(lines: DataFrame, *, line: str, patterns: DataFrame | None = None) -> DataFrame:
    """``lines`` that hold a result, with ``grammar, raw_name, value, unit, reference_range, status, confidence, pattern_test``.

    Args:
        patterns: see ``pattern_rows``; ``pattern_test`` and ``confidence`` of a line that one of them reads follow from it.

    Names aren't resolved here, so the confidences are those of unknown names. Null lines and lines of less than three
    characters hold nothing.
    """
    text = F.col("_text")
    found = lines.withColumn("_text", F.replace(trimmed(line), F.lit(_MARK), F.lit(" "))).where((F.length(text) >= 3) & ~is_noise(text))
    tables, others = GRAMMARS[:3], GRAMMARS[3:]
    # Of the three forms of tables the first that fits decides, and so does its label.
    table = F.when(text.rlike(tables[-1][3]), F.coalesce(*[_row(text, g) for g in tables]))
    row = F.coalesce(once(table, _labelled), *[once(_row(text, g), _labelled) for g in others])
    kinds = "struct<grammar: string, raw_name: string, value: string, unit: string, reference_range: string, pattern_test: string, pattern_confidence: double>"
    full = lambda r: F.when(r.isNotNull(), F.struct(*[r[c].alias(c) for c in ("grammar", "raw_name", "value", "unit", "reference_range")], F.lit(None).cast("string").alias("pattern_test"), F.lit(None).cast("double").alias("pattern_confidence")))
    known = pattern_rows(patterns) if patterns is not None else []
    row = F.coalesce(once(row, full).cast(kinds), *[_by_pattern(text, p).cast(kinds) for p in known])
    # Exploded, so that the grammars run once for all fields of a row and for its being there.
    found = found.select("*", F.explode(F.filter(F.array(row), lambda r: r.isNotNull())).alias("_row"))
    numeric = F.col("_row.grammar").isin(*NUMERIC_GRAMMARS, "pattern")
    status = F.when(numeric, range_status("_row.value", "_row.reference_range")).otherwise(qualitative_status("_row.value", "_row.reference_range"))
    confidence = F.coalesce("_row.pattern_confidence", F.when(F.col("_row.grammar").isin(*TABULAR_GRAMMARS), 0.7).otherwise(0.75))
    fields = [F.col(f"_row.{c}").alias(c) for c in ("grammar", "raw_name", "value", "unit", "reference_range", "pattern_test")]
    return found.select(*lines.columns, *fields, status.alias("status"), confidence.alias("confidence"))


def read_alike(lines: DataFrame, read: Callable[[DataFrame, str], DataFrame], *, line: str, most: int = 100_000, size: int = 32_000_000, longest: int | None = None) -> DataFrame:
    """``read(lines, line)``, for lines of which many are alike: each text is read once, and what it holds is told to all its lines.

    Args:
        read: a table of lines and the name of their column to some of its rows, with further columns that follow from the
            line alone; null lines hold nothing.
        longest: lines of more characters are read one by one, as they are seldom alike.

    A first pass writes the distinct texts. If they are more than ``most``, or take more than ``size`` bytes, the lines
    are read one by one. Give lines that are cheap to make, since the passes make them.
    """
    short = lines if longest is None else lines.where(F.length(line) <= longest)
    said = materialize(short.select(F.col(line).alias("_said")).where("_said IS NOT NULL").distinct(), "lines-said")
    n, taken = said.limit(most + 1).agg(F.count("*"), F.sum(F.octet_length("_said"))).first()
    if n > most or (taken or 0) > size:
        return read(lines, line)
    long = None if longest is None else read(lines.where(F.length(line) > longest), line)
    known = read(said, "_said")
    told = short.join(F.broadcast(materialize(known, "lines-read")), F.col(line) == F.col("_said"))
    told = told.select(*lines.columns, *[c for c in known.columns if c != "_said"])
    return told if long is None else told.unionByName(long)


def parse_repeated_rows(lines: DataFrame, *, line: str, patterns: DataFrame | None = None, most: int = 100_000, size: int = 32_000_000, longest: int | None = None) -> DataFrame:
    """``parse_rows``, for lines of which many are alike: see ``read_alike``."""
    return read_alike(lines, lambda rows, text: parse_rows(rows, line=text, patterns=patterns), line=line, most=most, size=size, longest=longest)

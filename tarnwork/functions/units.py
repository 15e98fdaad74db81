"""Spellings of units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwork.functions.text import col

CUBIC_MM = r"(?:cu\.?mm|c\.mm|cmm|mm3|ul)"
#: What a count is scaled by, in its spellings, and the name that stands for it.
SCALES = {"thou": "thou|thousands?|k|x?10\\^?3|x?10³", "lakh": "lakhs?", "mill": "mill|millions?|x?10\\^?6|x?10⁶"}
#: A micro-unit per millilitre is a milli-unit per litre.
SAME_UNIT = {"uiu/ml": "miu/l", "iu/l": "u/l"}


def normalize_unit(unit: Column | str) -> Column:
    """One spelling for each unit: case, spaces, micro signs and names of the cubic millimetre don't count."""
    text = F.regexp_replace(F.lower(F.coalesce(col(unit), F.lit(""))), r"(?U)\s+", "")
    text = F.replace(F.translate(text, "µμ", "uu"), F.lit("mcg"), F.lit("ug"))
    found = F.when(text.rlike(rf"^(?:cells?)?/?{CUBIC_MM}$"), "/ul")
    for name, spellings in SCALES.items():
        found = found.when(text.rlike(rf"^(?:{spellings})(?:cells?)?/{CUBIC_MM}$"), f"{name}/ul")
    for spelling, unit_ in SAME_UNIT.items():
        found = found.when(text == spelling, unit_)
    return found.otherwise(text)


def section_of_unit(unit: Column | str) -> Column:
    """The section that a unit implies: urine (per field), dlc (percent), alc (cells per volume), else null."""
    unit = F.coalesce(col(unit), F.lit(""))
    cells = r"(?i)thou|lakh|mill|10\s*\^|x\s*10|cells|/\s*c\.?u?\.?\s*mm|/\s*mm3|/\s*[uµμ]l\b"
    return F.when(unit.rlike(r"(?i)\b[hl]pf\b"), "urine").when(F.contains(unit, F.lit("%")), "dlc").when(unit.rlike(cells), "alc")

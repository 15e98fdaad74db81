"""Prescriptions: which text stands for a file, and the medicines in it, from a model's reply or by a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import col, once, trimmed

#: The lengths that fields are cut to, how many medicines are kept, the shortest text layer that is taken
#: as it is, the longest text, the endings of photos, and what a medicine with its dose looks like.
FIELD_LENGTHS = {"medication_name": 200, "dosage": 100, "frequency": 100, "duration": 100, "instructions": 2000}
MOST_MEDICATIONS, LEAST_LAYER, MOST_TEXT = 60, 120, 20_000
PHOTO_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".gif", ".heic", ".heif")
MEDICATION = r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)(?U:\s)+(\d+(?U:\s)*mg|\d+(?U:\s)*ml|\d+(?U:\s)*tablet|\d+(?U:\s)*capsule)"

#: Why a file gives no text.
NO_PHOTO_READER, EMPTY_PHOTO, NO_SCAN_READER, EMPTY_FILE = "photo needs a reader", "no text in photo", "no text layer and no reader", "no text"


def is_photo(file_name: Column | str) -> Column:
    name = F.lower(F.coalesce(col(file_name), F.lit("")))
    return F.exists(F.array(*map(F.lit, PHOTO_ENDINGS)), lambda e: F.endswith(name, e))


def chosen_text(file_name: Column | str, layer: Column | str, recognised: Column | str) -> Column:
    """``struct<text, text_source, error>`` of a file.

    A photo has only what was recognised. Another file's own text layer is taken if it is long enough; a shorter one is a
    scan's stray text, so what was recognised goes before it. A null ``recognised`` says that no reader was there: then any
    layer is better than none. Texts are trimmed, and cut to ``MOST_TEXT`` where the layer is long or recognised text was asked for.
    """
    given = F.struct(is_photo(file_name).alias("photo"), trimmed(F.coalesce(col(layer), F.lit(""))).alias("layer"), trimmed(col(recognised)).alias("seen"))

    def told(x: Column) -> Column:
        result = lambda text, source, error=None: F.struct(text.alias("text"), F.lit(source).cast("string").alias("text_source"), F.lit(error).cast("string").alias("error"))
        none, cut = F.lit(None).cast("string"), lambda text: F.left(text, F.lit(MOST_TEXT))
        photo = F.when(x["seen"].isNull(), result(none, None, NO_PHOTO_READER)).when(x["seen"] == "", result(none, None, EMPTY_PHOTO)).otherwise(result(x["seen"], "photo"))
        unread = F.when(x["layer"] == "", result(none, None, NO_SCAN_READER)).otherwise(result(x["layer"], "pdf"))
        scan = F.when(x["seen"] != "", result(cut(x["seen"]), "ocr")).when(x["layer"] != "", result(cut(x["layer"]), "ocr")).otherwise(result(none, None, EMPTY_FILE))
        return F.when(x["photo"], photo).when(F.length(x["layer"]) >= LEAST_LAYER, result(cut(x["layer"]), "pdf")).when(x["seen"].isNull(), unread).otherwise(scan)

    return once(given, told)


def _medication(**fields: Column) -> Column:
    """One medicine with its fields trimmed and cut; null without a name."""
    plain = {f: F.left(trimmed(F.coalesce(fields.get(f, F.lit("")), F.lit(""))), F.lit(n)) for f, n in FIELD_LENGTHS.items()}
    return once(F.struct(*[c.alias(f) for f, c in plain.items()]), lambda x: F.when(x["medication_name"] != "", x))


def _kept(medications: Column) -> Column:
    return F.slice(F.filter(medications, lambda m: m.isNotNull()), 1, MOST_MEDICATIONS)


def printed_medications(text: Column | str) -> Column:
    """The first medicine with a dose of each line, in order."""
    lines = F.filter(F.split(col(text), "\n"), lambda line: line.rlike(MEDICATION))
    return _kept(F.transform(lines, lambda line: _medication(medication_name=F.regexp_extract(line, MEDICATION, 1), dosage=F.regexp_extract(line, MEDICATION, 2))))


def replied_medications(reply: Column | str) -> Column:
    """The medicines of a model's reply: an object with a list ``medications``, maybe in a fence or among words.

    Items that aren't objects or have no name go. Values of other types count as their JSON text; null, false and empty
    lists and objects as empty. No reply, or one of another shape, has none.
    """
    plain = trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(col(reply), F.lit("")), r"(?is)<think>.*?</think>", ""), r"(?i)```(?:json)?", ""))
    whole = F.when(F.try_parse_json(plain).isNotNull(), plain).otherwise(F.regexp_extract(plain, r"(?s)\{.*\}", 0))
    raw = once(whole, lambda t: F.when(t.rlike(r"^\s*\{"), F.from_json(t, "medications string"))["medications"])
    items = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>"))
    schema = ", ".join(f"{f} string" for f in FIELD_LENGTHS)

    def told(item: Column) -> Column:
        filled = lambda v: F.when(~v.isin("false", "[]", "{}"), v)
        return once(F.when(item.rlike(r"^\s*\{"), F.from_json(item, schema)), lambda x: _medication(**{f: filled(x[f]) for f in FIELD_LENGTHS}))

    return F.coalesce(_kept(F.transform(items, told)), F.array().cast(f"array<struct<{schema.replace(' string', ':string')}>>"))


def read_prescriptions(files: DataFrame, *, file_name: str, layer: str, recognised: str, reply: str) -> DataFrame:
    """``files`` with ``text``, ``text_source``, ``error``, ``medications``, ``read_by`` and ``parsed_successfully``.

    Medicines are those of the reply (``ai``); if it names none, those found by the pattern (``patterns``). A file without
    text has none, whatever the reply says, and ``read_by`` is null. No row is shuffled or dropped. ``files`` has no columns
    of these names.
    """
    texts = files.select("*", chosen_text(file_name, layer, recognised).alias("chosen")).select(*files.columns, "chosen.*")
    replied = texts.select("*", F.when(F.col("text").isNotNull(), replied_medications(reply)).alias("replied"))
    by_model = F.size("replied") > 0
    found = replied.select("*", F.when(by_model, F.col("replied")).otherwise(printed_medications(F.coalesce("text", F.lit("")))).alias("medications"))
    return found.select(*texts.columns, "medications", F.when(F.col("text").isNotNull(), F.when(by_model, "ai").otherwise("patterns")).alias("read_by"), (F.size("medications") > 0).alias("parsed_successfully"))

"""Structured replies of language models: whatever shape they come in, one shape comes out.

A reply is JSON text. Fields that should be lists may be single texts, items may be texts or objects, numbers may be
texts. Each value is read as raw text first, so that nothing of another shape makes the rest of the reply null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwork.functions.text import col, once, trimmed

#: How many entries and texts are kept, the lengths that texts are cut to, and what stands for a missing value.
MOST_ENTRIES, MOST_TEXTS = 5, 12
TEXT_LENGTH, NAME_LENGTH, REASON_LENGTH, REMARK_LENGTH = 600, 200, 2000, 1000
LIKELIHOODS = ("most likely", "possible", "less likely")
NO_NAME, NO_ADVICE, NO_CONFIDENCE = "Unknown Condition", "Consult with a healthcare professional.", 3

_REPLY = ("differential", "false_positives", "summary", "description", "condition_name", "confidence_score", "recommendations", "follow_up_required", "follow_up_notes", "patterns", "cautions", "red_flags")
_ENTRY = ("condition", "condition_name", "likelihood", "confidence", "reasoning", "supporting", "against", "confirm_with", "rule_out_with")
_FALSE = ("condition", "why_it_might_be_wrong", "why", "how_to_tell", "how_to_tell_apart")


def _object(text: Column, fields: tuple[str, ...]) -> Column:
    """The fields of a JSON object as raw texts; null for other JSON."""
    return F.when(text.rlike(r"^\s*\{"), F.from_json(text, ", ".join(f"`{f}` string" for f in fields)))


def _items(raw: Column) -> Column:
    """The items of a JSON array as raw texts; no items for other JSON."""
    return F.coalesce(F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>")), F.array().cast("array<string>"))


def _first(*texts: Column) -> Column:
    """The first text that isn't empty, trimmed; else an empty one."""
    return trimmed(F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit("")))


def texts_of(raw: Column, most: int = MOST_TEXTS) -> Column:
    """Short texts from a list or a single text: of objects their ``text``; blank ones go."""
    single = F.when(F.coalesce(raw, F.lit("")) != "", F.array(raw))
    items = F.when(raw.rlike(r"^\s*\["), _items(raw)).otherwise(F.coalesce(F.when(~raw.rlike(r"^\s*\{"), single), F.array().cast("array<string>")))
    plain = F.transform(items, lambda x: F.left(trimmed(F.coalesce(F.when(x.rlike(r"^\s*\{"), F.get_json_object(x, "$.text")).otherwise(x), F.lit(""))), F.lit(TEXT_LENGTH)))
    return F.slice(F.filter(plain, lambda x: x != ""), 1, most)


def confidence_of(raw: Column, default: int = NO_CONFIDENCE) -> Column:
    """A whole number from 1 to 5; what isn't a number is the default."""
    number = trimmed(raw).try_cast("double")
    return F.when(number.isNull() | F.isnan(number), default).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), number.cast("int"))))


def _entries(raw: Column, of: Callable[[Column], Column]) -> Column:
    return F.slice(F.filter(F.transform(_items(raw), of), lambda x: x.isNotNull()), 1, MOST_ENTRIES)


def candidate(raw: Column) -> Column:
    """One entry of a differential; null without a condition, and for what is no object."""

    def told(x: Column) -> Column:
        name, likelihood = _first(x["condition"], x["condition_name"]), F.lower(trimmed(F.coalesce(x["likelihood"], F.lit(""))))
        lists = [texts_of(x[f]).alias(f) for f in ("supporting", "against", "confirm_with", "rule_out_with")]
        entry = F.struct(F.left(name, F.lit(NAME_LENGTH)).alias("condition"), F.when(likelihood.isin(*LIKELIHOODS), likelihood).otherwise("possible").alias("likelihood"), confidence_of(x["confidence"]).alias("confidence"), F.left(_first(x["reasoning"]), F.lit(REASON_LENGTH)).alias("reasoning"), *lists)
        return F.when(name != "", entry)

    return once(_object(raw, _ENTRY), told)


def false_positive(raw: Column) -> Column:
    """One entry of what might be taken for the condition: an object, or a text that names it; null without a name."""

    def told(x: Column) -> Column:
        name = F.when(x.isNotNull(), _first(x["condition"])).otherwise(_first(raw))
        remark = lambda *fields: F.left(F.when(x.isNotNull(), _first(*[x[f] for f in fields])).otherwise(""), F.lit(REMARK_LENGTH))
        return F.when(name != "", F.struct(F.left(name, F.lit(NAME_LENGTH)).alias("condition"), remark("why_it_might_be_wrong", "why").alias("why_it_might_be_wrong"), remark("how_to_tell", "how_to_tell_apart").alias("how_to_tell")))

    return once(_object(raw, _FALSE), told)


def normalize_reply(reply: Column | str) -> Column:
    """A reply as one struct: the leading entry fills what the reply doesn't say itself.

    Invalid entries go, lists and texts are cut, confidences lie between 1 and 5. A null reply, or one that is no object,
    is read like an empty one.
    """
    empty = F.from_json(F.lit("{}"), ", ".join(f"`{f}` string" for f in _REPLY))

    def told(r: Column) -> Column:
        def with_entries(entries: Column) -> Column:
            leading = F.get(entries, F.lit(0))
            summary = _first(r["summary"], r["description"])
            name = _first(r["condition_name"], leading["condition"])
            confidence = F.when(r["confidence_score"].isNotNull(), confidence_of(r["confidence_score"])).otherwise(F.coalesce(leading["confidence"], F.lit(NO_CONFIDENCE)))
            follow_up = ~F.lower(trimmed(F.coalesce(r["follow_up_required"], F.lit("true")))).isin("false", "0", "0.0", "", "[]", "{}")
            analysis = F.struct(summary.alias("summary"), entries.alias("differential"), _entries(r["false_positives"], false_positive).alias("false_positives"), *[texts_of(r[f]).alias(f) for f in ("patterns", "cautions", "red_flags")])
            return F.struct(
                F.left(F.coalesce(F.nullif(name, F.lit("")), F.lit(NO_NAME)), F.lit(NAME_LENGTH)).alias("condition_name"), F.coalesce(F.nullif(summary, F.lit("")), leading["reasoning"], F.lit("")).alias("description"),
                confidence.alias("confidence_score"), F.coalesce(F.nullif(_first(r["recommendations"]), F.lit("")), F.lit(NO_ADVICE)).alias("recommendations"),
                follow_up.alias("follow_up_required"), _first(r["follow_up_notes"]).alias("follow_up_notes"), analysis.alias("analysis"),
            )

        return once(_entries(r["differential"], candidate), with_entries)

    return once(F.coalesce(_object(F.coalesce(col(reply), F.lit("")), _REPLY), empty), told)

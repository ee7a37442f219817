"""Lenient reading of booleans, enumerations and dynamic values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.dates import from_epoch, moment_text, parse_moment
from paperloom.functions.numbers import as_integer, parse_decimal
from paperloom.functions.text import trimmed

# Words for true and false.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1"), ("false", "no", "n", "0")


def to_boolean(text: Column) -> Column:
    """True or false from words or any number (nought is false); else null."""
    s = F.lower(trimmed(text))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False).when(s.rlike(r"^[+-]?\d+(\.\d+)?$"), s.try_cast("double").cast("bigint") != 0)


def to_enum(text: Column, values: list[str]) -> Column:
    """The allowed value that equals the string, or equals it but for case; else null."""
    s = trimmed(text)
    exact = F.when(s.isin(*values), s)
    loose = F.coalesce(*[F.when(F.lower(s) == v.lower(), F.lit(v)) for v in values])
    return F.coalesce(exact, loose)


def coerce_leaf(text: Column, kind: str, locale: Column | None = None, values: list[str] | None = None) -> Column:
    """A leaf of a dynamic record as the text of its schema type, null where it is none.

    ``text`` is the JSON scalar as text; kinds: string, number, integer, boolean, date,
    date-time, enum.
    """
    number = parse_decimal(text, locale)
    if kind == "enum":
        return to_enum(text, values or [])
    if kind == "string":
        return trimmed(text)
    if kind == "boolean":
        return to_boolean(text).cast("string")
    if kind in ("number", "integer"):
        word = F.lower(trimmed(text))
        value = F.when(word == "true", F.lit(1).cast("decimal(38,18)")).when(word == "false", F.lit(0).cast("decimal(38,18)")).otherwise(number)
        return as_integer(value).cast("string") if kind == "integer" else value.cast("string")
    moment = F.coalesce(F.when(trimmed(text).rlike(r"^-?\d{9,}(\.\d+)?$"), from_epoch(trimmed(text).try_cast("double"))), parse_moment(text, locale))
    if kind == "date":
        return F.date_format(moment, "yyyy-MM-dd")
    return moment_text(moment)


def problem(value: Column, coerced: Column, path: str, kind: str, required: bool) -> Column:
    """The message for a leaf that could not be read, or null."""
    missing = F.when(F.lit(required) & value.isNull(), F.lit(f"Missing required field {path}"))
    wrong = F.when(value.isNotNull() & coerced.isNull(), F.format_string(f"Expected {kind} at {path}, got %s", value))
    return F.coalesce(missing, wrong)

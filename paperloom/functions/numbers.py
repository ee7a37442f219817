"""Numbers written by people and models, as column expressions on DECIMAL(38,18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import BLANKS, let, trimmed

DECIMAL = "decimal(38,18)"
# Decimal and grouping mark by language of the locale.
COMMA_DECIMAL = ("de", "fr", "es", "it", "pt", "nl", "sv", "da", "nb", "fi", "pl", "ru", "tr", "id")
DOT_DECIMAL = ("en", "zh", "ja", "ko", "he", "th", "ar")
MINUSES = "−﹣－"
CURRENCY_PREFIXES = "USD EUR GBP JPY CHF CAD".split()


def _marks(locale: Column) -> tuple[Column, Column]:
    language = F.lower(F.split_part(F.regexp_replace(F.coalesce(locale, F.lit("")), "-", "_"), F.lit("_"), F.lit(1)))
    decimal = F.when(language.isin(*COMMA_DECIMAL), ",").when(language.isin(*DOT_DECIMAL), ".").otherwise("")
    grouping = F.when(decimal == ",", ".").when(decimal == ".", ",").otherwise("")
    return decimal, grouping


def plain_separators(cleaned: Column, locale: Column) -> Column:
    """Digits with at most a dot as decimal mark, from digits with dots and commas."""
    decimal, grouping = _marks(locale)
    facts = F.struct(cleaned.alias("t"), decimal.alias("dec"), grouping.alias("grp"), F.regexp_count(cleaned, F.lit(r"\.")).alias("dots"), F.regexp_count(cleaned, F.lit(",")).alias("commas"))
    return let(facts, _separated)


def _separated(f: Column) -> Column:
    t, bare = f["t"], F.regexp_replace(f["t"], "^[+-]", "")
    dot_last = F.regexp_replace(t, ",", "")
    comma_last = F.translate(F.regexp_replace(t, r"\.", ""), ",", ".")
    both = F.when(F.length(F.substring_index(t, ".", -1)) < F.length(F.substring_index(t, ",", -1)), dot_last).otherwise(comma_last)

    def single(mark: str, count: Column, otherwise: Column) -> Column:
        pattern = r"\." if mark == "." else ","
        stripped = F.regexp_replace(t, pattern, "")
        grouped = bare.rlike(rf"^\d{{1,3}}(?:{pattern}\d{{3}})+$")
        return (
            F.when((f["dec"] == mark) & (count == 1), F.translate(t, mark, "."))
            .when((f["grp"] == mark) & (grouped | (count == 1)), stripped)
            .when(count > 1, F.when(grouped, stripped).otherwise(t))
            .otherwise(otherwise)
        )

    one_comma = F.when(bare.rlike(r"^\d*,\d{1,2}$|^0,\d+$"), F.translate(t, ",", ".")).otherwise(dot_last)
    return F.when((f["dots"] > 0) & (f["commas"] > 0), both).when(f["dots"] > 0, single(".", f["dots"], t)).when(f["commas"] > 0, single(",", f["commas"], one_comma)).otherwise(t)


def parse_decimal(text: Column, locale: Column | None = None) -> Column:
    """The number a string means, or null: signs in front, behind or as parentheses, currency
    words, grouping and decimal marks of the locale, scientific notation.  Whatever could be
    read two ways is null; beyond 38 digits null too.
    """
    locale = F.lit(None).cast("string") if locale is None else locale

    def unwrapped(s: Column) -> Column:
        in_parens = s.rlike(r"^\(.*\)$") & (F.length(s) >= 2)
        inner = F.when(in_parens, trimmed(F.regexp_replace(s, r"^\(|\)$", ""))).otherwise(s)
        return let(F.struct(in_parens.alias("parens"), inner.alias("inner")), signed)

    def signed(u: Column) -> Column:
        behind = F.regexp_extract(u["inner"], rf"([+-]){BLANKS}*$", 1)
        body = trimmed(F.regexp_replace(u["inner"], rf"[+-]{BLANKS}*$", ""))
        refused = u["parens"] & ((u["inner"] == "") | u["inner"].rlike(r"[()]"))
        return let(F.struct(u["parens"].alias("parens"), behind.alias("behind"), body.alias("body"), refused.alias("refused")), valued)

    def valued(u: Column) -> Column:
        body, behind = u["body"], u["behind"]
        refused = u["refused"] | ((behind != "") & (body.rlike(r"[+-]$") | u["parens"])) | ~body.rlike("[0-9]")
        negative = u["parens"] | (behind == "-")
        letters = F.regexp_replace(body, "[^A-Za-z]", "")
        scientific = body.rlike(r"\d[eE]") | letters.rlike("^[eE]+$")
        plain = let(plain_separators(F.regexp_replace(body, r"[^0-9.,+-]", ""), locale), lambda p: _literal(p, behind, negative))
        return F.when(refused, None).when(scientific, let(F.split(body, "[eE]"), lambda parts: _scientific(parts, behind, negative, locale))).otherwise(plain)

    return let(F.translate(trimmed(text), MINUSES, "---"), unwrapped)


def _number(text: Column) -> Column:
    return F.regexp_replace(text, r"^\.", "0.").try_cast(DECIMAL)


def _literal(p: Column, behind: Column, negative: Column) -> Column:
    value = _number(F.regexp_replace(p, r"^[+-]", ""))
    ok = p.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$") & ~(p.rlike("^[+-]") & (behind != ""))
    return F.when(ok, F.when(negative | p.startswith("-"), -value).otherwise(value))


def _scientific(parts: Column, behind: Column, negative: Column, locale: Column) -> Column:
    """Exactly one exponent mark; only junk before the first digit is passed over."""
    head = F.element_at(parts, 1)
    front = F.regexp_extract(head, r"^[^0-9.,]*?([+-])[^0-9.,]*", 1)
    mantissa = F.regexp_replace(F.regexp_replace(head, r"^[^0-9.,]+", ""), r"[ \t]", "")
    exponent = trimmed(F.try_element_at(parts, F.lit(2)))

    def scaled(normal: Column) -> Column:
        ok = (F.size(parts) == 2) & exponent.rlike(r"^[+-]?\d{1,4}$") & (F.abs(exponent.try_cast("int")) <= 127) & normal.rlike(r"^(?:\d+\.?\d*|\.\d+)$") & ~((front != "") & (behind != ""))
        value = F.concat(F.regexp_replace(normal, r"^\.", "0."), F.lit("e"), exponent).try_cast(DECIMAL)
        return F.when(ok, F.when(negative | (front == "-"), -value).otherwise(value))

    return let(plain_separators(mantissa, locale), scaled)


def close_to(a: Column, b: Column, tolerance: str = "0.01") -> Column:
    """Within the tolerance, which is included (0.01 for invariants, 0.02 for scoring)."""
    return F.abs(a.cast(DECIMAL) - b.cast(DECIMAL)) <= F.lit(tolerance).cast(DECIMAL)


def as_integer(value: Column) -> Column:
    """The number if it equals its rounding, else null."""
    return F.when(F.round(value, 0) == value, value.cast("bigint"))


def compact_number(value: Column) -> Column:
    """Shortest text of a number: no trailing zeros, integers without a point."""
    text = value.cast(DECIMAL).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def fixed(value: Column, digits: int) -> Column:
    return value.cast(f"decimal(38,{digits})").cast("string")


def search_candidates(value: Column) -> Column:
    """Ways in which a number can stand in a text, without repeats."""
    whole = F.round(value, 0) == value
    return F.array_distinct(F.when(whole, F.array(compact_number(value), fixed(value, 0), fixed(value, 2))).otherwise(F.array(compact_number(value), fixed(value, 2), fixed(value, 1))))


def numeric_skeleton(text: Column) -> Column:
    """Digits and dots, a minus only right before a digit, commas gone, all else a blank."""
    dashes = F.translate(text, MINUSES + ",", "---")
    return F.trim(F.regexp_replace(F.regexp_replace(dashes, r"-(?!\d)", " "), r"[^0-9.\-]+", " "))


def holds_number(text: Column, candidate: Column) -> Column:
    """Containment of a written number; an unsigned one does not sit behind a minus."""
    quoted = F.regexp_replace(candidate, r"([.\-+])", r"\\$1")
    pattern = F.when(candidate.startswith("-"), quoted).otherwise(F.concat(F.lit(f"(?<![-{MINUSES}])"), quoted))
    # Plain containment is cheap, and without it no pattern is made.
    return (candidate != "") & F.contains(text, candidate) & F.regexp_like(text, pattern)


def distinctive_number(text: Column) -> Column:
    """Three digits or more, or a decimal or grouping mark beside a digit."""
    digits = F.regexp_count(text, F.lit(r"\d"))
    return (digits >= 3) | ((digits >= 1) & text.rlike(r"[.,]"))


def table_numeric(text: Column) -> Column:
    """Is a table cell a number: currency, grouping and a percent sign aside?"""
    bare = F.regexp_replace(F.regexp_replace(trimmed(text), r"[$€£¥,]", ""), rf"^(?:{'|'.join(CURRENCY_PREFIXES)}){BLANKS}*", "")
    return trimmed(F.regexp_replace(bare, "%$", "")).rlike(r"^[0-9.\-]*[0-9][0-9.\-]*$")


def amount_in_text(text: Column, amount: Column) -> Column:
    """Does an amount stand in the text: plain, with a comma, grouped the English or German way?"""
    two = fixed(amount, 2)
    english = F.format_number(amount, 2)
    german = F.translate(english, ",.", ".,")
    return F.exists(F.array_distinct(F.array(compact_number(amount), F.translate(compact_number(amount), ".", ","), two, F.translate(two, ".", ","), english, german)), lambda c: F.contains(text, c))

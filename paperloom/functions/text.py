"""Text normal forms, matching predicates and small text repairs as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\p{Z}\x{85}]"
# Cyrillic and Greek letters and the Latin ones they are read as.
LOOKALIKE_FROM = "АВСЕНКМОРТХУІЈЅасеорхуѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"
LOOKALIKE_TO = "ABCEHKMOPTXYIJSaceopxysijABEZHIKMNOPTYXov"
# Languages written in Latin letters.
LATIN_LANGUAGES = (
    "en", "de", "fr", "es", "it", "pt", "nl", "sv", "no", "nb", "nn", "da", "fi", "is",
    "pl", "cs", "sk", "sl", "hr", "hu", "ro", "tr", "et", "lv", "lt", "ga", "cy", "ca",
    "eu", "gl", "af", "sq", "id", "ms", "sw", "vi", "tl", "mt", "lb",
)
# Marks of list items.
LIST_MARKERS = r"[•◦▪‣·∙●○■□–—\-*+>]|\(?\d{1,2}[.)]|\(?[a-zA-Z][.)]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(text: Column) -> Column:
    """Without blanks of any kind at both ends (Spark's trim knows only the space)."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Accented letters that decompose to one letter and marks, and those letters; by rule."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def without_accents(text: Column) -> Column:
    source, target = _accents()
    return F.regexp_replace(F.translate(text, source, target), r"[\x{300}-\x{36F}]", "")


def for_search(text: Column) -> Column:
    """Case and accents folded, everything but letters, marks and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(without_accents(text)), r"[^\p{L}\p{M}\p{N}]+", " "))


def for_scoring(text: Column) -> Column:
    """Trimmed, lower case, runs of blanks as one."""
    return F.regexp_replace(F.lower(trimmed(text)), f"{BLANKS}+", " ")


def scoring_contains(haystack: Column, needle: Column) -> Column:
    """Containment of the scoring forms; an empty needle is contained in nothing."""
    return (for_scoring(needle) != "") & F.contains(for_scoring(haystack), for_scoring(needle))


def same_or_within(a: Column, b: Column) -> Column:
    """Equal, or either contains the other, in the scoring form (party and line matching)."""
    x, y = for_scoring(a), for_scoring(b)
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x))


def for_zone(text: Column) -> Column:
    """The form of machine-readable zones: fillers as blanks, accents and case folded."""
    return F.trim(F.regexp_replace(F.upper(without_accents(F.translate(text, "<", " "))), f"{BLANKS}+", " "))


def token_coverage(value: Column, normal_document: Column) -> Column:
    """At least half of the value's tokens of three letters or more occur in the document's
    search form (by substring); false where there is no such token."""
    tokens = F.filter(F.split(for_search(value), " "), lambda t: F.length(t) >= 3)
    hits = F.filter(tokens, lambda t: F.contains(normal_document, t))
    return (F.size(tokens) > 0) & (F.size(hits) * 2 >= F.size(tokens))


def latin_repair(text: Column) -> Column:
    return F.translate(text, LOOKALIKE_FROM, LOOKALIKE_TO)


def latin_only(tags: Column) -> Column:
    """A list of language tags that is not empty and names only Latin-written languages."""
    return (F.size(tags) > 0) & F.forall(tags, lambda t: F.lower(F.split_part(F.regexp_replace(t, "_", "-"), F.lit("-"), F.lit(1))).isin(*LATIN_LANGUAGES))


def is_list_marker(text: Column) -> Column:
    t = trimmed(text)
    return t.rlike(f"^(?:{LIST_MARKERS})$") | ((F.length(t) == 1) & ~t.rlike(r"[\p{L}\p{N}]"))


def strip_list_marker(text: Column) -> Column:
    """Without a leading marker, if a blank and content follow it."""
    return F.regexp_replace(trimmed(text), rf"^(?:{LIST_MARKERS}|[^\p{{L}}\p{{N}}\s]){BLANKS}+(?=\S)", "")


def pages_of(text: Column) -> Column:
    """Page texts of a document rendered with ``--- Page n ---`` lines."""
    parts = F.split(text, r"(?m)^--- Page \d+ ---[ \t]*\n?")
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def page_count(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit(r"(?m)^--- Page \d+ ---")), F.lit(1))


def cut_inside_token(text: Column, at: Column) -> Column:
    """Does a cut before the (0-based) offset part two letters or two digits?"""
    pair = F.substring(text, at, F.lit(2)) if isinstance(at, int) else F.substr(text, at, F.lit(2))
    return (at > 0) & pair.rlike(r"^(?:\p{L}{2}|\p{Nd}{2})$")

"""Is a page's text layer readable?  A score from 0 to 1 as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import BLANKS, trimmed, without_accents

THRESHOLD = 0.85
_CJK = r"\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
# Blocks of single scripts.
SCRIPTS = {"greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}", "cyrillic": r"\x{0400}-\x{052F}", "hebrew": r"\x{0590}-\x{05FF}", "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}", "devanagari": r"\x{0900}-\x{097F}", "thai": r"\x{0E00}-\x{0E7F}"}


def well_formed(token: Column) -> Column:
    """A number, two digits, or letters (all but one character) that could be a word: with a
    vowel in Latin, of one script elsewhere."""
    bare = F.regexp_replace(token, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")
    letters, digits = F.regexp_count(bare, F.lit(r"[\p{L}\p{M}]")), F.regexp_count(bare, F.lit(r"\p{Nd}"))
    plain = F.lower(without_accents(bare))
    latin = plain.rlike(r"[a-z]") & F.when(F.length(bare) <= 3, plain.rlike(r"[aeiouyøœæ]") | bare.rlike(r"^\p{Lu}+$")).otherwise(plain.rlike(r"[aeiouyøœæ]"))
    single = F.lit(False)
    for block in SCRIPTS.values():
        single = single | bare.rlike(rf"^[{block}\p{{M}}\p{{Nd}}'’.\-]+$")
    wordy = (letters >= 2) & (letters >= F.length(bare) - 1)
    return bare.rlike(r"^[+-]?\d+([.,]\d+)*%?$") | (digits >= 2) | (wordy & (latin | single | bare.rlike(rf"^[{_CJK}]+$")))


def token_share(token: Column) -> Column:
    """The share of good pieces of a token; tokens with ideographs break between ideographs
    and everything else."""
    pieces = F.filter(F.split(F.regexp_replace(token, rf"(?<=[{_CJK}])(?=[^{_CJK}])|(?<=[^{_CJK}])(?=[{_CJK}])", " "), " "), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    good = F.filter(pieces, lambda p: p.rlike(rf"^[{_CJK}]+$") | well_formed(p) | (F.length(p) == 1))
    cjk = F.when(F.size(pieces) == 0, 0.0).otherwise(F.size(good) / F.size(pieces))
    return F.when(token.rlike(rf"[{_CJK}]"), cjk).otherwise(F.when(well_formed(token), 1.0).otherwise(0.0))


def text_quality(text: Column) -> Column:
    """Half the share of letters and digits, half the mean token share; at most 0.3 with
    replacement characters or stray control codes; 0 for a blank text."""
    clean = trimmed(F.regexp_replace(text, r"\p{Cf}", ""))
    solid = F.regexp_replace(clean, f"{BLANKS}+", "")
    alnum = F.regexp_count(solid, F.lit(r"[\p{L}\p{M}\p{N}]")) / F.length(solid)
    tokens = F.filter(F.split(clean, f"{BLANKS}+"), lambda t: t != "")
    mean = F.aggregate(F.transform(tokens, token_share), F.lit(0.0), lambda a, b: a + b) / F.size(tokens)
    score = 0.5 * alnum + 0.5 * mean
    capped = F.when(clean.rlike(r"\x{FFFD}|[\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}]"), F.least(score, F.lit(0.3))).otherwise(score)
    return F.when(F.coalesce(solid, F.lit("")) == "", F.lit(0.0)).otherwise(F.least(F.greatest(capped, F.lit(0.0)), F.lit(1.0)))


def needs_recognition(policy: str, text: Column) -> Column:
    """The gate of a page: 'always' trusts the text layer, 'never' does not, 'auto' asks the
    score."""
    if policy == "always":
        return F.lit(False)
    if policy == "never":
        return F.lit(True)
    return text_quality(text) < THRESHOLD

"""Dates of records, machine-readable zones and invoices as column expressions (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import let, trimmed

# Ways to write a moment, tried in order; the numeric ones go first, by the locale.
FORMATS = ("yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
MONTH_FIRST = ("MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy")
DAY_FIRST = ("dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy")
# Languages whose month stands before the day in the public locale data, the
# regions of English in which it does, and the locales that differ from their language.
MONTH_FIRST_LANGUAGES = frozenset(
    "ak asa bem bez bgc bho blo bo brx ce ceb cgg chr ckb csw dav dz ebu ee eo eu fa fil gaa guz gv ha hu ii ja jmc kam kde ki kl kln ko ks ksb ksh "
    "kw lag lg lij lkt lmo lrc lt luo luy mas mer mgo mn mt mzn naq nd nds ne nnh nqo nso nyn oc om or prg ps qu raj rof rw rwk sah saq sat sbp sd se "
    "si sn so st szl teo tn tok tzm vai vmw vun xh xog yi yue za zh zu".split()
)
MONTH_FIRST_ENGLISH = frozenset("as bi ca gu mh mp ph pr um us vi za".split())
MONTH_FIRST_ELSEWHERE = ("es_pa", "es_pr", "fr_ca")
DAY_FIRST_ELSEWHERE = ("se_fi", "zh_hk", "zh_mo")


def from_epoch(number: Column) -> Column:
    """Seconds, or from 1e10 on milliseconds, since 1970."""
    return F.when(F.abs(number) >= 10_000_000_000, F.timestamp_micros((number * 1000).cast("bigint"))).otherwise(F.timestamp_micros((number * 1_000_000).cast("bigint")))


def day_first(locale: Column) -> Column:
    """Does the locale write the day before the month?  A tag is read by its language and its
    region (``en``, ``en-US``, ``zh_Hant_TW``); a language without region stands for its
    default one.  Unknown languages write the day first, an empty or null locale does not."""
    parts = F.split(F.lower(F.regexp_replace(F.coalesce(locale, F.lit("")), "-", "_")), "_")
    language = F.element_at(parts, 1)
    # A script or a variant may stand beside the region; the region has two letters or three digits.
    region = F.coalesce(F.try_element_at(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p.rlike("^([a-z]{2}|[0-9]{3})$")), F.lit(1)), F.lit(""))
    place = F.concat_ws("_", language, region)
    month = F.when(language == "en", (region == "") | region.isin(*sorted(MONTH_FIRST_ENGLISH)))
    month = month.when(place.isin(*MONTH_FIRST_ELSEWHERE), True).when(place.isin(*DAY_FIRST_ELSEWHERE), False)
    return (language != "") & ~month.otherwise(language.isin(*sorted(MONTH_FIRST_LANGUAGES)))


def strict_day(text: Column) -> Column:
    """The date of ``yyyy-MM-dd`` and nothing else, if the calendar has it."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def parse_moment(text: Column, locale: Column | None = None) -> Column:
    """Timestamp of a date string, or null; a day the calendar lacks is null."""
    locale = F.lit(None).cast("string") if locale is None else locale
    return let(trimmed(text), lambda s: _parsed(s, locale))


def _parsed(s: Column, locale: Column) -> Column:
    opens = s.rlike(r"^\d{4}-\d{2}-\d{2}")
    day_ok = ~opens | F.substring(s, 1, 10).try_cast("date").isNotNull()
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"), s.try_cast("timestamp"))
    bare = strict_day(s).cast("timestamp")
    shaped = {
        "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "MM-dd-yyyy": r"^\d{2}-\d{2}-\d{4}$",
        "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
        "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$", "MMM d, yyyy": r"^\p{L}{3} \d{1,2}, \d{4}$", "MMMM d, yyyy": r"^\p{L}{3,} \d{1,2}, \d{4}$",
        "d MMM yyyy": r"^\d{1,2} \p{L}{3} \d{4}$", "d MMMM yyyy": r"^\d{1,2} \p{L}{3,} \d{4}$",
        "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    }

    def read(formats: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(s.rlike(shaped[f]), F.try_to_timestamp(F.initcap(s) if "MMM" in f else s, F.lit(f))) for f in formats])

    numeric = F.when(day_first(locale), read(DAY_FIRST + MONTH_FIRST)).otherwise(read(MONTH_FIRST + DAY_FIRST))
    return F.when(day_ok, F.coalesce(bare, iso, numeric, read(FORMATS)))


def moment_text(moment: Column) -> Column:
    """The date alone at midnight, else ISO date and time with Z."""
    midnight = F.date_trunc("day", moment) == moment
    return F.when(midnight, F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def invoice_date(text: Column) -> Column:
    """``yyyyMMdd``, ``yyyy-MM-dd`` or ``yyyyMMddHHmmss`` of e-invoices."""
    s = trimmed(text)
    return F.coalesce(
        F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd"))),
        strict_day(s).cast("timestamp"),
        F.when(s.rlike(r"^\d{14}$"), F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss"))),
    )


def date_in_text(text: Column, moment: Column) -> Column:
    return F.exists(F.array(*[F.date_format(moment, f) for f in ("yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy")]), lambda d: F.contains(text, d))


def zone_date(raw: Column, reference: Column, birth: bool) -> Column:
    """Date of ``YYMMDD``; the century by the reference day.

    A birth lies in 20yy if that year is not after the reference's, else in 19yy, and a
    hundred years earlier while it still is after the reference day.  An expiry takes 20yy
    or 19yy, whichever lies within fifty years of the reference, 20yy first, else the nearer.
    A filler reads as nought; a day the calendar lacks is null.
    """
    return let(F.translate(raw, "<", "0"), lambda digits: _zone_day(digits, reference, birth))


def _zone_day(digits: Column, reference: Column, birth: bool) -> Column:
    ok = digits.rlike(r"^\d{6}$")
    yy, mm, dd = (F.substring(digits, i, 2).try_cast("int") for i in (1, 3, 5))
    year = F.year(reference)
    early, late = 1900 + yy, 2000 + yy
    make = lambda y: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mm.cast("string"), 2, "0"), F.lpad(dd.cast("string"), 2, "0")).try_cast("date")
    if birth:
        first = F.when(late <= year, late).otherwise(early)
        made = make(first)
        return F.when(ok, F.when(made > reference, make(first - 100)).otherwise(made))
    within = lambda y: F.abs(y - year) <= 50
    chosen = F.when(within(late), late).when(within(early), early).when(F.abs(late - year) <= F.abs(early - year), late).otherwise(early)
    return F.when(ok, make(chosen))


def dates_agree(zone_raw: Column, written: Column, resolved: Column) -> Column:
    """Does an extracted date agree with a zone's: filler with empty, six digits raw, else by day?"""
    empty = F.coalesce(trimmed(written), F.lit("")) == ""
    filler = F.coalesce(zone_raw, F.lit("")).rlike("^[<]*$")
    return F.when(empty | filler, empty & filler).when(trimmed(written).rlike(r"^\d{6}$"), trimmed(written) == zone_raw).otherwise(F.coalesce(F.to_date(parse_moment(written)) == resolved, F.lit(False)))

"""Literal cases of the scalar functions."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperloom.functions import coerce, dates, mrz, numbers, quality, text

MARKS = {"en_US": (",", "."), "de_DE": (".", ","), "es-MX": None, "pl_PL": (".", ","), "ja_JP": (",", "."), None: None}


def _written(rng):
    """(text, locale, value): a number in one of the ways in which people write it."""
    locale = rng.choice(["en_US", "de_DE", "pl_PL", "ja_JP", None])
    grouping, decimal = MARKS[locale] or rng.choice([(",", "."), (".", ",")])
    whole, cents = rng.choice([rng.randrange(10), rng.randrange(1000), rng.randrange(10**7)]), f"{rng.randrange(100):02}"
    body = f"{whole:,}".replace(",", grouping) if rng.random() < 0.5 else str(whole)
    value, body = Decimal(f"{whole}.{cents}"), f"{body}{decimal}{cents}"
    front, behind, factor = rng.choice([("", "", 1), ("-", "", -1), ("−", "", -1), ("+", "", 1), ("", "-", -1), ("", " -", -1), ("", "+", 1), ("(", ")", -1)])
    if rng.random() < 0.3 and not front and not behind:
        front = rng.choice(["EUR ", "$", "CHF ", "£"])
    return f"{front}{body}{behind}", locale, value * factor


def _scientific(rng):
    mantissa, power = Decimal(rng.randrange(1, 1000)) / 10, rng.randrange(-6, 9)
    return f"{mantissa}{rng.choice('eE')}{power:{rng.choice(['', '+'])}}", None, mantissa.scaleb(power)


def _meaningless(rng):
    """Texts that can be read as no number, or as two."""
    n, m, k = rng.randrange(10, 99), rng.randrange(10, 99), rng.randrange(1, 9)
    return rng.choice([f"-{n}-", f"--{n}", f"{n}--", f"{n} - {m}", f"(({n}))", f"{k}.{n}.{m}", f"{k},{n},{m}", f"e{n}", f"{k}e{n}e{m}", f"{k}e{k}.{k}", f"{n}e{n + 128}", "¾", "٤٥", "none", "CHF", " \t"]), None, None


def test_decimals(spark):
    rng = random.Random(23)
    cases = [f(rng) for f in (_written, _scientific, _meaningless) for _ in range(250)] + [("", None, None), (None, None, None), ("  7 ", None, Decimal(7)), (".5", None, Decimal("0.5")), ("8.", None, Decimal(8))]
    # The mark that only groups in a locale parts no decimals there.
    cases += [(f"{n},{n}", "en_US", Decimal(f"{n}{n}")) for n in (31, 64)] + [(f"{n}.{n}", "de_DE", Decimal(f"{n}{n}")) for n in (31, 64)]
    df = spark.createDataFrame([(t, loc, None if v is None else str(v)) for t, loc, v in cases], "s string, l string, want string")
    for row in df.select("s", "l", "want", numbers.parse_decimal(F.col("s"), F.col("l")).alias("got")).collect():
        assert row.got == (None if row.want is None else Decimal(row.want)), row


def test_decimals_round_trip(spark):
    rng = random.Random(7)
    values = [Decimal(rng.randint(-10**9, 10**9)) / 100 for _ in range(300)]
    written = [(f"{v:,.2f}", "en_US", str(v)) for v in values] + [(f"{v:,.2f}".translate(str.maketrans(",.", ".,")), "de_DE", str(v)) for v in values]
    for row in spark.createDataFrame(written, "s string, l string, want string").select("want", numbers.parse_decimal(F.col("s"), F.col("l")).alias("got")).collect():
        assert row.got == Decimal(row.want)


def test_numbers(spark):
    one = spark.range(1)
    d = lambda s: F.lit(s).cast(numbers.DECIMAL)
    row = one.select(
        numbers.compact_number(d("1250.00")).alias("a"), numbers.compact_number(d("12.50")).alias("b"), numbers.search_candidates(d("1250")).alias("c"), numbers.holds_number(F.lit("paid -12.5 now"), F.lit("12.5")).alias("d"),
        numbers.holds_number(F.lit("paid 1234 now"), F.lit("12")).alias("e"), numbers.distinctive_number(F.lit("12")).alias("f"), numbers.distinctive_number(F.lit("1.2")).alias("g"), numbers.as_integer(d("2.5")).alias("h"),
        numbers.table_numeric(F.lit("USD 1,200.50")).alias("i"), numbers.table_numeric(F.lit("n/a")).alias("j"), numbers.close_to(d("1.00"), d("1.01")).alias("k"), numbers.close_to(d("1.00"), d("1.02")).alias("l"),
        numbers.amount_in_text(F.lit("Summe 1.234,50"), d("1234.5")).alias("m"),
    ).first()
    assert row.a == "1250" and row.b == "12.5" and row.c == ["1250", "1250.00"]
    assert (row.d, row.e, row.f, row.g, row.h) == (False, True, False, True, None)
    assert (row.i, row.j, row.k, row.l, row.m) == (True, False, True, False, True)


@pytest.mark.parametrize(
    "written, locale, day",
    [
        *[("07/09/2018", tag, "2018-07-09") for tag in ("en_US", "en", "en-CA", "EN_ph", "zh", "zh_Hant_TW", "ja", "ko", "hu", "lt_LT", "fil", "fr-CA", "es_PR", "", None)],
        *[("07/09/2018", tag, "2018-09-07") for tag in ("en_GB", "en-IN", "de", "fr", "es_MX", "it_IT", "sv_SE", "zh_HK", "se_FI", "pt-BR", "xx")],
        ("26/09/2018", "en_US", "2018-09-26"), ("2021-02-30", None, None), ("45/19/2021", None, None), ("2019-06-31T10:00:00Z", None, None), ("28 FEB 2016", None, "2016-02-28"), ("Oct 9, 2011", "de", "2011-10-09"), (" ", "en", None), (None, "en", None),
    ],
)
def test_dates(spark, written, locale, day):
    df = spark.createDataFrame([(written, locale)], "s string, l string")
    got = df.select(F.to_date(dates.parse_moment(F.col("s"), F.col("l"))).alias("d")).first().d
    assert got == (dt.date.fromisoformat(day) if day else None)


def test_epoch_and_centuries(spark):
    row = spark.range(1).select(
        F.unix_seconds(dates.from_epoch(F.lit(1609459200.0))).alias("s"), F.unix_seconds(dates.from_epoch(F.lit(1609459200000.0))).alias("ms"),
        dates.zone_date(F.lit("740812"), F.to_date(F.lit("2026-07-27")), True).alias("birth"), dates.zone_date(F.lit("301231"), F.to_date(F.lit("2026-07-27")), False).alias("expiry"), dates.zone_date(F.lit("990231"), F.to_date(F.lit("2026-07-27")), True).alias("bad"),
    ).first()
    assert row.s == row.ms == 1609459200
    assert (row.birth, row.expiry, row.bad) == (dt.date(1974, 8, 12), dt.date(2030, 12, 31), None)


def test_coercion(spark):
    df = spark.createDataFrame([("true",), (" YES",), ("n",), ("2",), ("0",), ("maybe",), (None,)], "s string")
    assert [r.b for r in df.select(coerce.to_boolean(F.col("s")).alias("b")).collect()] == [True, True, False, True, False, None, None]
    got = spark.range(1).select(coerce.to_enum(F.lit("ADMIN"), ["admin", "user"]).alias("e"), coerce.coerce_leaf(F.lit("true"), "integer").alias("i"), coerce.coerce_leaf(F.lit("2.5"), "integer").alias("j"), coerce.coerce_leaf(F.lit("Mar 5, 2020"), "date").alias("d")).first()
    assert (got.e, got.i, got.j, got.d) == ("admin", "1", None, "2020-03-05")


def test_text_forms(spark):
    row = spark.range(1).select(
        text.for_search(F.lit("Crème  BRÛLÉE-12")).alias("a"), text.for_zone(F.lit("DOE<<JANÉ")).alias("b"), text.strip_list_marker(F.lit("1. Apples")).alias("c"), text.strip_list_marker(F.lit("1.")).alias("d"), text.latin_repair(F.lit("Тоtal")).alias("e"),
        text.scoring_contains(F.lit("abc"), F.lit("")).alias("f"), text.token_coverage(F.lit("lamp Blue"), F.lit("a blue lamp")).alias("g"), text.cut_inside_token(F.lit("ab12"), F.lit(1)).alias("h"), text.cut_inside_token(F.lit("ab12"), F.lit(2)).alias("i"), text.trimmed(F.lit(" x ")).alias("j"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("creme brulee 12", "DOE JANE", "Apples", "1.", "Total")
    assert (row.f, row.g, row.h, row.i, row.j) == (False, True, True, False, "x")


def test_quality(spark):
    texts = [("The quick brown fox jumps over the lazy dog.", True), ("Xq zrt bcd fgh ~~~ ### %%%", False), ("\x01\x02 broken layer text", False), ("", False), ("これは日本語の文章です", True), ("وصلت الكاميرا متأخرة", True), (None, False)]
    rows = spark.createDataFrame(texts, "t string, good boolean").select("t", "good", quality.text_quality(F.coalesce("t", F.lit(""))).alias("q")).collect()
    for row in rows:
        assert (row.q >= quality.THRESHOLD) == row.good, row


ZONES = [
    (1, 0, "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"), (1, 1, "L898902C36UTO7408122F1204159ZE184226B<<<<<10"), (2, 0, "hello"), (2, 1, "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<"), (2, 2, ""), (2, 3, "D231458907UTO7408122F1204159<<<<<<<6"),
    (3, 0, "I<UTOD231458907<<<<<<<<<<<<<<<"), (3, 1, "7408122F1204159UTO<<<<<<<<<<<6"), (3, 2, "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"), (4, 0, "no zone here"), (5, 0, None),
]


def test_zones(spark):
    lines = spark.createDataFrame(ZONES, "doc_id bigint, ord int, text string")
    rows = {r.doc_id: r for r in mrz.parse_zones(lines, F.to_date(F.lit("2026-07-27"))).collect()}
    assert set(rows) == {1, 2, 3}
    assert [rows[k].kind for k in (1, 2, 3)] == ["TD3", "TD2", "TD1"]
    assert all(r.zone.all_ok and r.zone.names.surname == "ERIKSSON" and r.zone.names.given_names == "ANNA MARIA" for r in rows.values())


def test_zone_mutation_is_noticed(spark):
    bad = [(d, o, t[:9] + str((int(t[9]) + 1) % 10) + t[10:] if (d, o) == (1, 1) else t) for d, o, t in ZONES if d == 1]
    zone = mrz.parse_zones(spark.createDataFrame(bad, "doc_id bigint, ord int, text string"), F.to_date(F.lit("2026-07-27"))).first().zone
    assert (zone.number_ok, zone.composite_ok, zone.birth_ok, zone.expiry_ok) == (False, False, True, True)


def test_cross_check(spark):
    zones = mrz.parse_zones(spark.createDataFrame(ZONES, "doc_id bigint, ord int, text string"), F.to_date(F.lit("2026-07-27")))
    extracted = spark.createDataFrame([(1, "surname", "Eriksson"), (1, "dateOfBirth", "1974-08-12"), (1, "expiryDate", "2012-04-16"), (1, "unmapped", "x")], "doc_id bigint, field string, value string")
    assert {r.field: r.agrees for r in mrz.cross_check(zones, extracted).collect()} == {"surname": True, "dateOfBirth": True, "expiryDate": False}

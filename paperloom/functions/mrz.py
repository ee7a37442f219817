"""Machine-readable zones: lines, formats, check digits, fields and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.dates import dates_agree, zone_date
from paperloom.functions.text import for_zone, trimmed

# Lines and length of each format.
FORMATS = {"TD1": (3, 30), "TD2": (2, 36), "TD3": (2, 44)}
WEIGHTS = (7, 3, 1)


def zone_line(text: Column) -> Column:
    """A line in the zone's form: trimmed, upper case, no blanks."""
    return F.regexp_replace(F.upper(trimmed(text)), r"[\s\p{Z}]", "")


def is_zone_line(line: Column) -> Column:
    return line.rlike("^[A-Z0-9<]+$") & F.length(line).isin(30, 36, 44)


def check_digit(field: Column) -> Column:
    """Weighted sum modulo ten: digits as they are, A = 10 and so on, filler 0."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).when(c == "<", 0).otherwise(F.instr(F.lit(letters), c) + 9)
    terms = F.transform(F.split(field, ""), lambda c, i: F.when(c == "", 0).otherwise(value(c) * F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (i % 3) + 1)))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10


def _part(line: Column, begin: int, end: int) -> Column:
    return F.substring(line, begin + 1, end - begin)


def _passes(field: Column, digit: Column) -> Column:
    return F.when(digit == "<", check_digit(field) == 0).otherwise(check_digit(field).cast("string") == digit)


def _clean(field: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(field, "<", " "), " +", " "))


def names_of(field: Column) -> Column:
    """Struct ``surname, given_names`` split at the first double filler."""
    at = F.instr(field, "<<")
    surname = F.when(at > 0, F.substr(field, F.lit(1), at - 1)).otherwise(field)
    given = F.when(at > 0, F.substr(field, at + 2)).otherwise(F.lit(""))
    return F.struct(_clean(surname).alias("surname"), _clean(given).alias("given_names"))


def fields_of(one: Column, two: Column, three: Column, kind: Column, reference: Column) -> Column:
    """All fields and checks of a zone as a struct; null for no known format."""

    def made(code, state, number, nationality, birth, sex, expiry, names, optional, checks):
        passed = F.array_compact(F.array(*checks.values()))
        return F.struct(
            code.alias("document_code"), state.alias("issuing_state"), _clean(number).alias("document_number"), _clean(nationality).alias("nationality"),
            birth.alias("birth_raw"), zone_date(birth, reference, True).alias("date_of_birth"), F.translate(sex, "<", "").alias("sex"),
            expiry.alias("expiry_raw"), zone_date(expiry, reference, False).alias("expiry_date"), names_of(names).alias("names"), _clean(optional).alias("optional_data"),
            *[v.alias(f"{k}_ok") for k, v in checks.items()],
            F.forall(passed, lambda x: x).alias("all_ok"), F.size(F.filter(passed, lambda x: x)).alias("score"),
        )

    none = F.lit(None).cast("boolean")
    body = lambda l, end: F.concat(_part(l, 0, 10), _part(l, 13, 20), _part(l, 21, end))
    td3 = made(
        _clean(_part(one, 0, 2)), _clean(_part(one, 2, 5)), _part(two, 0, 9), _part(two, 10, 13), _part(two, 13, 19), _part(two, 20, 21), _part(two, 21, 27), _part(one, 5, 44), _part(two, 28, 42),
        {
            "number": _passes(_part(two, 0, 9), _part(two, 9, 10)), "birth": _passes(_part(two, 13, 19), _part(two, 19, 20)), "expiry": _passes(_part(two, 21, 27), _part(two, 27, 28)),
            "optional": _passes(_part(two, 28, 42), _part(two, 42, 43)), "composite": _passes(F.concat(_part(two, 0, 10), _part(two, 13, 20), _part(two, 21, 28), _part(two, 28, 43)), _part(two, 43, 44)),
        },
    )
    td2 = made(
        _clean(_part(one, 0, 2)), _clean(_part(one, 2, 5)), _part(two, 0, 9), _part(two, 10, 13), _part(two, 13, 19), _part(two, 20, 21), _part(two, 21, 27), _part(one, 5, 36), _part(two, 28, 35),
        {
            "number": _passes(_part(two, 0, 9), _part(two, 9, 10)), "birth": _passes(_part(two, 13, 19), _part(two, 19, 20)), "expiry": _passes(_part(two, 21, 27), _part(two, 27, 28)),
            "optional": none, "composite": _passes(body(two, 35), _part(two, 35, 36)),
        },
    )
    td1 = made(
        _clean(_part(one, 0, 2)), _clean(_part(one, 2, 5)), _part(one, 5, 14), _part(two, 15, 18), _part(two, 0, 6), _part(two, 7, 8), _part(two, 8, 14), three, F.concat(_part(one, 15, 30), _part(two, 18, 29)),
        {
            "number": _passes(_part(one, 5, 14), _part(one, 14, 15)), "birth": _passes(_part(two, 0, 6), _part(two, 6, 7)), "expiry": _passes(_part(two, 8, 14), _part(two, 14, 15)),
            "optional": none, "composite": _passes(F.concat(_part(one, 5, 30), _part(two, 0, 7), _part(two, 8, 15), _part(two, 18, 29)), _part(two, 29, 30)),
        },
    )
    return F.when(kind == "TD3", td3).when(kind == "TD2", td2).when(kind == "TD1", td1)


def zone_candidates(lines: DataFrame, key: str = "doc_id", ord: str = "ord", text: str = "text") -> DataFrame:
    """Windows of two or three consecutive zone lines that make a format:
    ``key, first_ord, kind, line1, line2, line3``.  Blank lines do not interrupt a run."""
    filled = lines.select(key, F.col(ord).alias("first_ord"), zone_line(F.col(text)).alias("line")).where("line <> ''")
    order = Window.partitionBy(key).orderBy("first_ord")
    numbered = filled.withColumn("_n", F.row_number().over(order)).where(is_zone_line(F.col("line")))
    # Islands: lines whose number and rank among zone lines go up together.
    numbered = numbered.withColumn("_island", F.col("_n") - F.row_number().over(order))
    within = Window.partitionBy(key, "_island").orderBy("first_ord")
    ahead = numbered.withColumn("_2", F.lead("line", 1).over(within)).withColumn("_3", F.lead("line", 2).over(within))
    size = F.length("line")
    kinds = F.array_compact(
        F.array(
            F.when((size == 30) & (F.length("_2") == 30) & (F.length("_3") == 30), F.lit("TD1")),
            F.when((size == 36) & (F.length("_2") == 36), F.lit("TD2")),
            F.when((size == 44) & (F.length("_2") == 44), F.lit("TD3")),
        )
    )
    return ahead.select(key, "first_ord", F.explode(kinds).alias("kind"), F.col("line").alias("line1"), F.col("_2").alias("line2"), F.when(F.col("kind") == "TD1", F.col("_3")).alias("line3"))


def parse_zones(lines: DataFrame, reference: Column, key: str = "doc_id", ord: str = "ord", text: str = "text") -> DataFrame:
    """The best zone of each document: all checks passed first, then most passed, then more
    lines, then the longer line, then the first: ``key, kind, zone``."""
    read = zone_candidates(lines, key, ord, text).withColumn("zone", fields_of(F.col("line1"), F.col("line2"), F.col("line3"), F.col("kind"), reference))
    rank = F.struct(F.col("zone.all_ok"), F.col("zone.score"), (F.col("kind") == "TD1"), F.length("line1"), -F.col("first_ord"))
    return read.groupBy(key).agg(F.max_by(F.struct("kind", "first_ord", "zone"), rank).alias("_b")).select(key, "_b.*")


def cross_check(zones: DataFrame, extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Zone fields beside extracted ones (``key, field, value``), only mapped fields:
    ``key, field, zone_value, value, agrees``."""
    z = F.col("zone")
    day = lambda c: c.cast("string")
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("field"), value.alias("zone_value"), raw.alias("raw"), resolved.alias("resolved"))
            for name, value, raw, resolved in (
                ("surname", z["names"]["surname"], F.lit(None).cast("string"), F.lit(None).cast("date")),
                ("givenNames", z["names"]["given_names"], F.lit(None).cast("string"), F.lit(None).cast("date")),
                ("fullName", F.concat_ws(" ", z["names"]["given_names"], z["names"]["surname"]), F.lit(None).cast("string"), F.lit(None).cast("date")),
                ("documentNumber", z["document_number"], F.lit(None).cast("string"), F.lit(None).cast("date")),
                ("nationality", z["nationality"], F.lit(None).cast("string"), F.lit(None).cast("date")),
                ("sex", z["sex"], F.lit(None).cast("string"), F.lit(None).cast("date")),
                ("dateOfBirth", day(z["date_of_birth"]), z["birth_raw"], z["date_of_birth"]),
                ("expiryDate", day(z["expiry_date"]), z["expiry_raw"], z["expiry_date"]),
            )
        ]
    )
    spread = zones.select(key, F.explode(rows).alias("_r")).select(key, "_r.*")
    joined = spread.join(extracted, [key, "field"])
    agrees = F.when(F.col("raw").isNotNull(), dates_agree(F.col("raw"), F.col("value"), F.col("resolved"))).otherwise(for_zone(F.coalesce("zone_value", F.lit(""))) == for_zone(F.coalesce("value", F.lit(""))))
    return joined.select(key, "field", "zone_value", "value", agrees.alias("agrees"))

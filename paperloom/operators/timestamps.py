"""Dates as people and devices write them, brought to one UTC moment.

The notation is read with column expressions (regular expressions and calendar
arithmetic, all inside the JVM).  Local times are then resolved by an as-of join: the
offset history of every zone is exploded into intervals of *local* time, keyed by
(zone, local year), and a local time is matched with the intervals that hold it.  Two
matching intervals mean a doubled (ambiguous) time, none means a skipped (nonexistent)
one, one gives the offset directly.  Both odd cases take the offset in force before the
change.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names in the languages of the supported locales.
MONTHS = {
    1: "january jan januar jän jänner janvier janv enero ene januari",
    2: "february feb februar février févr fév fevrier febrero februari",
    3: "march mar märz mrz mär maerz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo maj",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago augusti",
    9: "september sep sept septembre septiembre set",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}
# Zone abbreviations and their hours from UTC.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "cet": 1, "cest": 2, "est": -5, "edt": -4, "pdt": -7, "jst": 9}
# Regions that write the month first / the year first.
MONTH_FIRST = ("en_us", "en_ph")
#: Years whose regimes are listed.  Before the first no zone had left its local mean time.  Behind
#: the last each zone goes by its final rule, so a year has the changes of the year of CYCLE with
#: the same weekdays and length.
FIRST_YEAR, LAST_YEAR = 1800, 2128
CYCLE = range(2101, 2129)

_EPOCH = dt.datetime(1970, 1, 1)


@lru_cache(maxsize=None)
def _history(name: str) -> list[tuple[int, int]]:
    """(UTC second a regime begins, its offset) of one zone, found by bisection."""
    zone = zoneinfo.ZoneInfo(name)

    def offset(second: int) -> int:
        moment = (_EPOCH + dt.timedelta(seconds=second)).replace(tzinfo=dt.timezone.utc)
        return int(moment.astimezone(zone).utcoffset().total_seconds())

    begin = int((dt.datetime(FIRST_YEAR - 1, 1, 1) - _EPOCH).total_seconds())
    end = int((dt.datetime(LAST_YEAR + 1, 12, 1) - _EPOCH).total_seconds())
    step = 28 * 86400
    found, before, now = [(begin, offset(begin))], offset(begin), begin
    while now < end:
        after = offset(now + step)
        if after != before:
            low, high = now, now + step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if offset(middle) != before else (middle, high)
            before = offset(high)
            found.append((high, before))
            now = high
        else:
            now += step
    return found


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per zone and local year: the regimes that touch that year, in local seconds."""
    bounds = [int((dt.datetime(y, 1, 1) - _EPOCH).total_seconds()) for y in range(FIRST_YEAR, LAST_YEAR + 2)]
    far = 1 << 52
    for batch in batches:
        rows = []
        for name in batch["tz"]:
            regimes = _history(name)
            spans = []
            for ix, (start, off) in enumerate(regimes):
                low = -far if ix == 0 else start + off
                if ix + 1 < len(regimes):
                    change, then = regimes[ix + 1]
                    high, reach = change + off, max(change + off, change + then)
                else:
                    high = reach = far
                spans.append((low, high, reach, off))
            begin = 0
            for y in range(FIRST_YEAR, LAST_YEAR + 1):
                low = -far if y == FIRST_YEAR else bounds[y - FIRST_YEAR]
                high = far if y == LAST_YEAR else bounds[y - FIRST_YEAR + 1]
                while begin < len(spans) - 1 and spans[begin][2] <= low:
                    begin += 1
                held = []
                for span in spans[begin:]:
                    if span[0] >= high:
                        break
                    if span[2] > low:
                        held.append(span)
                rows.append((name, y, [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], [h[3] for h in held]))
        yield pd.DataFrame(rows, columns=["tz", "tz_year", "lows", "highs", "reaches", "offsets"])


def zone_intervals(names: DataFrame) -> DataFrame:
    """The local-time intervals of the zones named in the only column of ``names``.

    Columns ``tz, tz_year, spans array<struct<low, high, reach, off>>``.  Names that the tz
    database lacks have none, so the rows are bounded by the database itself: about 600 zones
    times 329 years, whatever the input holds.
    """
    given = F.trim(F.col(names.columns[0]))
    zones = names.select(given.alias("tz")).where(F.col("tz").isin(*sorted(zoneinfo.available_timezones()))).distinct()
    arrays = zones.mapInPandas(
        _intervals,
        "tz string, tz_year int, lows array<bigint>, highs array<bigint>, reaches array<bigint>, offsets array<int>",
    )
    spans = F.transform(
        F.arrays_zip("lows", "highs", "reaches", "offsets"),
        lambda z: F.struct(z["lows"].alias("low"), z["highs"].alias("high"), z["reaches"].alias("reach"), z["offsets"].alias("off")),
    )
    return arrays.select("tz", "tz_year", spans.alias("spans"))


def _month(name: Column) -> Column:
    pairs = [(word, number) for number, words in MONTHS.items() for word in words.split()]
    lookup = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.element_at(lookup, F.rtrim(F.lower(name), F.lit(".")))


def _number(value: Column) -> Column:
    return value.try_cast("int")


def cleaned(text: Column) -> Column:
    """The string in ordinary digits and single blanks, without invisible characters."""
    wide = "０１２３４５６７８９：／．－，＋　"
    s = F.regexp_replace(F.translate(text, wide, "0123456789:/.-,+ "), r"[\s\p{Z}]+", " ")
    s = F.regexp_replace(s, r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}]", "")
    return F.trim(s)


def parts_of(s: Column, locale: Column) -> Column:
    """Struct ``y, mo, d, h, mi, s, half, z`` of a cleaned string; null for no date."""
    loc = F.lower(F.regexp_replace(F.coalesce(locale, F.lit("")), "-", "_"))

    clock = r"(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?"
    zone = r" ?([AaPp]\.?[Mm]\.?)? ?(Z|z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|[+-]\d{2})?"
    tail = clock + zone + "$"
    shapes = {
        "ymd": r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + tail,
        "compact": r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)? ?(Z|z|[+-]\d{2}:?\d{2})?$",
        "cjk": r"^(\d{4})[年년] ?(\d{1,2})[月월] ?(\d{1,2})[日일]?" + tail,
        "num": r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + tail,
        "dmy": r"^(?:\p{L}+\.?,? )?(\d{1,2})\.?(?: de | |-)(\p{L}+\.?)(?: de | del |,? |-)(\d{4}|\d{2})" + tail.replace("[T ]", "(?:T|,? )"),
        "mdy": r"^(?:\p{L}+,? )?(\p{L}+\.?) (\d{1,2}),? (\d{4})" + tail.replace("[T ]", "(?:T|,? )"),
    }

    def group(kind: str, ix: int) -> Column:
        return F.regexp_extract(s, shapes[kind], ix)

    number = _number

    def full_year(value: Column) -> Column:
        return F.when(F.length(value) == 2, number(value) + 2000).otherwise(number(value))

    month_first = F.substring(loc, 1, 5).isin(*MONTH_FIRST)
    one, two = number(group("num", 1)), number(group("num", 3))
    # Without a locale the order is known only where one of the two can be no month.
    no_order = (loc == "") & (one <= 12) & (two <= 12) & (one != two)
    swap = F.when(loc == "", (two > 12)).otherwise(month_first) & (group("num", 2) != ".")
    no_text = F.lit("")

    def parts(year, month, day, hour, minute, second, half, offset):
        return F.struct(
            year.cast("int").alias("y"), month.cast("int").alias("mo"), day.cast("int").alias("d"),
            hour.alias("h"), minute.alias("mi"), second.alias("s"), F.lower(F.regexp_replace(half, r"\.", "")).alias("half"), offset.alias("z"),
        )

    return (
        F.when(s.rlike(shapes["ymd"]), parts(number(group("ymd", 1)), number(group("ymd", 3)), number(group("ymd", 4)), *[group("ymd", i) for i in (5, 6, 7, 8, 9)]))
        .when(s.rlike(r"^\d{8}$"), parts(number(F.substring(s, 1, 4)), number(F.substring(s, 5, 2)), number(F.substring(s, 7, 2)), *[no_text] * 5))
        .when(s.rlike(shapes["compact"]), parts(number(group("compact", 1)), number(group("compact", 2)), number(group("compact", 3)), group("compact", 4), group("compact", 5), group("compact", 6), no_text, group("compact", 7)))
        .when(s.rlike(shapes["cjk"]), parts(number(group("cjk", 1)), number(group("cjk", 2)), number(group("cjk", 3)), *[group("cjk", i) for i in (4, 5, 6, 7, 8)]))
        .when(
            s.rlike(shapes["num"]) & ~F.coalesce(no_order, F.lit(False)),
            parts(full_year(group("num", 4)), F.when(swap, one).otherwise(two), F.when(swap, two).otherwise(one), *[group("num", i) for i in (5, 6, 7, 8, 9)]),
        )
        .when(s.rlike(shapes["dmy"]), parts(full_year(group("dmy", 3)), _month(group("dmy", 2)), number(group("dmy", 1)), *[group("dmy", i) for i in (4, 5, 6, 7, 8)]))
        .when(s.rlike(shapes["mdy"]), parts(number(group("mdy", 3)), _month(group("mdy", 1)), number(group("mdy", 2)), *[group("mdy", i) for i in (4, 5, 6, 7, 8)]))
    )


def moment_of(s: Column, read: Column) -> Column:
    """Struct ``epoch_s, local_s, local_year``: an absolute moment, or a local time still
    without an offset; both null where the string means nothing.
    """
    number = _number
    date = F.when(read["y"].between(1, 9999), F.try_make_timestamp(read["y"], read["mo"], read["d"], F.lit(0), F.lit(0), F.lit(0)))
    day_s = F.unix_seconds(date)
    timed = read["h"] != ""
    hour, minute, second = number(read["h"]), number(read["mi"]), F.coalesce(number(read["s"]), F.lit(0))
    half = read["half"]
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), (hour % 12) + F.when(half == "pm", 12).otherwise(0))
    of_day = F.when((hour24 <= 23) & (minute <= 59) & (second <= 59), hour24 * 3600 + minute * 60 + second)
    local = day_s + of_day

    z = F.lower(read["z"])
    abbreviations = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 3600)])
    digits = F.regexp_extract(z, r"([+-])(\d{2}):?(\d{2})?$", 2)
    minutes = F.coalesce(number(F.regexp_extract(z, r"([+-])(\d{2}):?(\d{2})?$", 3)), F.lit(0))
    signed = (number(digits) * 3600 + minutes * 60) * F.when(z.contains("-"), -1).otherwise(1)
    offset = F.when(z.rlike(r"[+-]\d{2}"), F.when((number(digits) <= 18) & (minutes <= 59), signed)).otherwise(F.element_at(abbreviations, z))

    plain = s.rlike(r"^-?\d{9,}$")
    seconds = F.when(F.length(F.ltrim(s, F.lit("-"))) == 13, F.floor(s.try_cast("decimal(38,0)") / 1000)).otherwise(s.try_cast("bigint"))
    moment = (
        F.when(plain, seconds.cast("bigint"))
        .when(~timed & (z == "") & (half == ""), day_s)
        .when(timed & (z != ""), local - offset)
    )
    waiting = F.when(timed & (z == ""), local)
    # A year beyond the list stands for its like in the cycle, to which its local time is moved.
    starts = {_year_kind(y): y for y in CYCLE}
    like = F.create_map(*[F.lit(x) for kind, y in starts.items() for x in (kind, y)])
    first = F.try_make_timestamp(read["y"], F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    leap = (read["y"] % 4 == 0) & ((read["y"] % 100 != 0) | (read["y"] % 400 == 0))
    year = F.when(read["y"] > LAST_YEAR, F.element_at(like, F.dayofweek(first) + F.when(leap, 10).otherwise(0))).otherwise(F.greatest(read["y"], F.lit(FIRST_YEAR)))
    moved = F.when(read["y"] > LAST_YEAR, F.unix_seconds(first) - F.unix_seconds(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))).otherwise(0)
    return F.struct(moment.cast("bigint").alias("epoch_s"), waiting.cast("bigint").alias("local_s"), F.when(waiting.isNotNull(), year).cast("int").alias("local_year"), moved.cast("bigint").alias("moved_s"))


def _year_kind(year: int) -> int:
    """Day of week (from Sunday, 1) of a year's first day, and ten more if it is a leap year."""
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return dt.date(year, 1, 1).isoweekday() % 7 + 1 + 10 * leap


def to_moments(df: DataFrame, text: str, locale: str, zone: str, zone_names: DataFrame | None = None) -> DataFrame:
    """Add ``epoch_s`` (bigint) and ``reading`` to ``df``.

    ``reading`` is 'absolute' (the string carries its offset, is a bare date or an epoch
    number), 'exact', 'ambiguous' or 'nonexistent' (a local time of the named zone), or
    null where the string means no moment: null, empty, filler, impossible date or hour,
    unknown zone name, or a time with neither offset nor zone.  Every input row comes out
    once; columns of the input with clashing names are kept, ours replace none of them
    unless they are called ``epoch_s`` or ``reading``.

    Only the histories of zones that occur are made.  ``zone_names`` has their names in its one
    column where a cheaper table than ``df`` holds them; by default they are read off ``df``.
    """
    # Three steps, so that each is computed once for the next.
    read = df.drop("epoch_s", "reading").withColumn("_text", cleaned(F.col(text)))
    read = read.withColumn("_parts", parts_of(F.col("_text"), F.col(locale)))
    read = read.withColumn("_read", moment_of(F.col("_text"), F.col("_parts"))).drop("_text", "_parts")
    # The join side is bounded by the tz database (see zone_intervals), not by the data.
    zones = F.broadcast(zone_intervals(df.select(zone) if zone_names is None else zone_names).withColumnsRenamed({"tz": "_tz", "tz_year": "_tz_year", "spans": "_spans"}))
    joined = read.join(
        zones,
        (F.trim(F.col(zone)) == F.col("_tz")) & (F.col("_read.local_year") == F.col("_tz_year")),
        "left",
    )
    local = F.col("_read.local_s") - F.col("_read.moved_s")
    near = F.filter("_spans", lambda x: (x["low"] <= local) & (local < x["reach"]))
    exact = F.filter(near, lambda x: local < x["high"])
    resolved = joined.withColumn("_near", near).withColumn("_exact", exact)
    reading = (
        F.when(F.col("_read.epoch_s").isNotNull(), "absolute")
        .when(F.size("_exact") >= 2, "ambiguous")
        .when(F.size("_exact") == 1, "exact")
        .when(F.size("_near") >= 1, "nonexistent")
    )
    off = F.when(F.size("_exact") >= 1, F.try_element_at("_exact", F.lit(1))["off"]).otherwise(F.try_element_at("_near", F.lit(1))["off"])
    return (
        resolved.withColumn("reading", reading)
        .withColumn("epoch_s", F.coalesce(F.col("_read.epoch_s"), F.col("_read.local_s") - off))
        .drop("_read", "_tz", "_tz_year", "_spans", "_near", "_exact")
    )

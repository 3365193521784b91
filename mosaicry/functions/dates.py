"""Partial dates, movable feasts and what is derived from a date, as columns.

Dates are strings of any precision ("1980s", "1984", "1984-05", "1984-05-03");
times follow in EXIF ("1984:05:03 10:11:12") or ISO form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Precisions from coarse to fine.
PRECISION = {"century": 1, "decade": 2, "year": 3, "month": 4, "full": 5}
# Hours of the day with their names, first and last hour.
DAY_BANDS = (
    ("overnight", 0, 4), ("blue_hour_morning", 5, 5), ("golden_hour_morning", 6, 7), ("morning", 8, 10), ("midday", 11, 13),
    ("afternoon", 14, 16), ("golden_hour_evening", 17, 18), ("blue_hour_evening", 19, 19), ("night", 20, 23),
)
# Month names, day names from Monday, and seasons of the northern hemisphere by month.
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
SEASONS = "Winter Winter Spring Spring Spring Summer Summer Summer Autumn Autumn Autumn Winter".split()
# Dated feasts (month, day) in the order in which they are tried.
FEASTS = {
    "Christmas Day": (12, 25), "Christmas Eve": (12, 24), "Boxing Day": (12, 26), "New Year's Day": (1, 1), "New Year's Eve": (12, 31), "Valentine's Day": (2, 14),
    "St. Patrick's Day": (3, 17), "ANZAC Day": (4, 25), "Halloween": (10, 31), "Canada Day": (7, 1), "Remembrance Day": (11, 11),
}
# Feasts on the n-th weekday (0 is Monday) of a month, as month, weekday, n.
NTH_FEASTS = {"Canadian Thanksgiving": (10, 0, 2), "US Thanksgiving": (11, 3, 4), "Mother's Day": (5, 6, 2), "Father's Day": (6, 6, 3)}


def date_precision(d: Column) -> Column:
    """full, month, year or decade by the shape of the string; empty and null count as full."""
    s = F.trim(d)
    dashes = F.size(F.split(s, "-"))
    return (
        F.when(d.isNull() | (d == ""), "full").when(s.rlike("^[0-9]{4}$"), "year").when(s.rlike("^[0-9]{4}s$"), "decade")
        .when(dashes >= 3, "full").when(dashes == 2, "month").otherwise("year")
    )


def precise_enough(d: Column, minimum: str | None, stated: Column | None = None) -> Column:
    """Whether the stated or inferred precision is at least ``minimum``; unknown precisions count as full."""
    if minimum is None:
        return F.lit(True)
    p = date_precision(d) if stated is None else F.coalesce(F.when(stated != "", stated), date_precision(d))
    ranks = F.create_map(*[x for k, v in PRECISION.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(ranks, p), F.lit(5)) >= PRECISION.get(minimum, 1)


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("int")


def easter(year: Column) -> tuple[Column, Column]:
    """Month and day of Easter Sunday in the Gregorian calendar.

    The age of the moon gives the days from 21 March to the full moon, corrected for
    the century; the Sunday after it is Easter.
    """
    y = year.cast("int")
    golden, century = y % 19, _div(y, 100)
    moon = (19 * golden + 15 + century - _div(century, 4) - _div(8 * century + 13, 25)) % 30
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    weekday = (y + _div(y, 4) + moon + 2 - century + _div(century, 4)) % 7
    offset = moon - weekday
    month = 3 + _div(offset + 40, 44)
    return month.cast("int"), (offset + 28 - 31 * _div(month, 4)).cast("int")


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """Day of the month of the n-th ``weekday`` (0 is Monday)."""
    first = F.weekday(F.make_date(year, F.lit(month), F.lit(1)))
    return 1 + F.pmod(F.lit(weekday) - first, F.lit(7)) + 7 * (n - 1)


def decade(year: Column) -> Column:
    return F.concat((_div(year, 10) * 10).cast("string"), F.lit("s"))


def parse_moment(s: Column) -> Column:
    """struct(date, hour) of an EXIF or ISO string; both null if there is no full date, hour null without a time."""
    t = F.trim(s)
    d = F.translate(F.substring(t, 1, 10), ":", "-")
    parts = F.split(d, "-")
    ok = (F.length(t) >= 10) & (F.size(parts) >= 3)
    for i in range(3):
        ok = ok & F.get(parts, F.lit(i)).rlike("^\\s*[+-]?[0-9]+\\s*$")
    hour = F.when(F.substring(t, 11, 1).isin("T", " ") & (F.length(t) >= 13), F.substring(t, 12, 2).try_cast("int"))
    return F.struct(F.when(ok, d).alias("date"), F.when(ok, hour).alias("hour"))


def holiday(year: Column, month: Column, day: Column) -> Column:
    """The first feast that falls on the day, or null."""
    em, ed = easter(year)
    hits = [F.when((month == m) & (day == d), name) for name, (m, d) in FEASTS.items()]
    hits.append(F.when((month == em) & (day == ed), "Easter"))
    hits += [F.when((month == m) & (day == nth_weekday(year, m, w, n)), name) for name, (m, w, n) in NTH_FEASTS.items()]
    return F.coalesce(*hits)


def _named(i: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), i)


def temporal_fields(taken: Column, fallback: Column) -> Column:
    """struct(year, decade, month_name, season, day_name, holiday, time_of_day) of ``taken``, else of ``fallback``.

    All null without a full date; a date that does not exist (30 February) has no
    day name and no holiday.
    """
    a, b = parse_moment(taken), parse_moment(fallback)
    d = F.coalesce(a["date"], b["date"])
    hour = F.when(a["date"].isNotNull(), a["hour"]).otherwise(b["hour"])
    parts = F.split(d, "-")
    y, m, day = (F.get(parts, F.lit(i)).try_cast("int") for i in range(3))
    real = F.try_make_date(y, m, day) if hasattr(F, "try_make_date") else F.to_date(F.when(d.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-([0-2][0-9]|3[01])$") & (day <= F.dayofmonth(F.last_day(F.concat(F.substring(d, 1, 8), F.lit("01")).try_cast("date")))), d))
    # a one-element array binds each part once, however often it is used below
    known = F.array(F.struct(y.alias("y"), m.alias("m"), day.alias("d"), hour.alias("h"), real.alias("real")))

    def derive(k: Column) -> Column:
        ok = F.when(k["m"].between(1, 12), k["m"])
        there = k["real"].isNotNull()
        return F.struct(
            k["y"].alias("year"), decade(k["y"]).alias("decade"), _named(ok - 1, MONTHS).alias("month_name"), _named(ok - 1, SEASONS).alias("season"),
            F.when(there, _named(F.weekday(k["real"]), DAYS)).alias("day_name"), F.when(there, holiday(k["y"], k["m"], k["d"])).alias("holiday"),
            F.coalesce(*[F.when(k["h"].between(lo, hi), name) for name, lo, hi in DAY_BANDS]).alias("time_of_day"),
        )

    return F.get(F.transform(known, derive), F.lit(0))

"""Dates: the spellings that count as one, Julian days, ISO weeks, formatters and the CALENDAR columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Julian day of 1970-01-01.
JULIAN_EPOCH = 2440587
#: Days of 0001-01-01 and 9999-12-31 from 1970-01-01: what DATE covers here.
FIRST_DAY, LAST_DAY = -719162, 2932896
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
HYPHENS = "‐‑‒–—―−"

DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
ISO = r"^\+?0*(\d{4})-(\d{2})-(\d{2})"
FAR = r"^([+-])0*(\d{4,6})-(\d{2})-(\d{2})"
NAMED = r"^(\d{1,2})[- ]([A-Za-z]{3})[- ](\d{4})"
ORDINAL = r"^(\d{4})-(\d{3})(?!\d)"
WEEK = r"^(\d{4})-?W(\d{2})-?([1-7])"
TIME = r"^\d{2,4}:\d{2}:\d{2}$"


def parse_date(text: str) -> dt.date | None:
    """A constant as a date, in any accepted spelling."""
    text = text.translate({ord(h): "-" for h in HYPHENS})
    try:
        if m := re.match(ISO, text):
            return dt.date(int(m[1]), int(m[2]), int(m[3]))
        if m := re.match(NAMED, text):
            at = MONTHS.find(m[2].upper())
            return dt.date(int(m[3]), at // 3 + 1, int(m[1])) if at >= 0 and at % 3 == 0 else None
        if m := re.match(WEEK, text):
            return dt.date.fromisocalendar(int(m[1]), int(m[2]), int(m[3]))
        if m := re.match(ORDINAL, text):
            day = dt.date(int(m[1]), 1, 1) + dt.timedelta(int(m[2]) - 1)
            return day if day.year == int(m[1]) else None
    except ValueError:
        pass
    return None


def is_far(text: str) -> bool:
    """Whether a constant is a date with a sign, which Python's dates may not hold."""
    return bool(re.match(FAR, text.translate({ord(h): "-" for h in HYPHENS}))) and parse_date(text) is None


def parse_datetime(text: str) -> dt.datetime | None:
    try:
        return dt.datetime.strptime(text[:19], "%Y-%m-%dT%H:%M:%S") if re.match(DATETIME, text) else None
    except ValueError:
        return None


def parse_time(text: str) -> int | None:
    """Seconds of HH:MM:SS; hours may have up to four digits."""
    if not re.match(TIME, text):
        return None
    h, m, s = map(int, text.split(":"))
    return h * 3600 + m * 60 + s


def _try_date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def date_of_text(column: Column) -> Column:
    """A text column as a date, null where it is none: the same spellings as parse_date."""
    x = F.translate(column, HYPHENS, "-" * len(HYPHENS))
    part = lambda p, k: F.regexp_extract(x, p, k)
    month = F.instr(F.lit(MONTHS), F.upper(part(NAMED, 2)))
    named = F.when(month % 3 == 1, _try_date(part(NAMED, 3), (F.floor((month - 1) / 3) + 1).cast("string"), part(NAMED, 1)))
    year = F.when(part(WEEK, 1) != "", part(WEEK, 1)).otherwise(F.lit("2000"))
    week = F.when(part(WEEK, 2) != "", part(WEEK, 2)).otherwise(F.lit("1")).cast("int")
    weekday = F.when(part(WEEK, 3) != "", part(WEEK, 3)).otherwise(F.lit("1")).cast("int")
    monday = F.trunc(_try_date(year, F.lit("1"), F.lit("4")), "week")
    in_week = F.date_add(monday, (week - 1) * 7 + weekday - 1)
    in_week = F.when(F.weekofyear(in_week) == week, in_week)
    first = _try_date(F.when(part(ORDINAL, 1) != "", part(ORDINAL, 1)).otherwise(F.lit("2000")), F.lit("1"), F.lit("1"))
    ordinal = F.date_add(first, F.when(part(ORDINAL, 2) != "", part(ORDINAL, 2)).otherwise(F.lit("1")).cast("int") - 1)
    ordinal = F.when((F.year(ordinal) == F.year(first)) & (part(ORDINAL, 2) != "000"), ordinal)
    whole = lambda k: part(FAR, k).try_cast("int")
    year = F.when(part(FAR, 1) == "-", -whole(2)).otherwise(whole(2))
    far = F.try_make_timestamp_ntz(year, whole(3), whole(4), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).cast("date")
    return (
        F.when(x.rlike(ISO), _try_date(part(ISO, 1), part(ISO, 2), part(ISO, 3)))
        .when(x.rlike(FAR), far)
        .when(x.rlike(NAMED), named)
        .when(x.rlike(WEEK), in_week)
        .when(x.rlike(ORDINAL), ordinal)
    )


def datetime_of_text(column: Column) -> Column:
    return F.when(column.rlike(DATETIME), F.try_to_timestamp(F.substring(column, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"))


def seconds_of_text(column: Column) -> Column:
    parts = F.split(column, ":")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("long")
    return F.when(column.rlike(TIME), number(1) * 3600 + number(2) * 60 + number(3))


def format_date(d: Column) -> Column:
    """Years before 0 with a sign, as they are written in constants."""
    return F.when(F.year(d) < 0, F.concat(F.lit("-"), _year4(-F.year(d)), F.date_format(d, "-MM-dd"))).otherwise(F.date_format(d, "yyyy-MM-dd"))


def format_datetime(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")


def format_seconds(s: Column) -> Column:
    """Seconds as HH:MM:SS with as many hours as there are."""
    a = F.abs(s)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(a / 3600)
    text = F.concat_ws(":", F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), two(F.floor(a / 60) % 60), two(a % 60))
    return F.when(s < 0, F.concat(F.lit("-"), text)).otherwise(text)


def _year4(y: Column) -> Column:
    return F.lpad(y.cast("string"), 4, "0")


def iso_year(d: Column) -> Column:
    return F.year(F.date_add(F.trunc(d, "week"), 3))


def julian(d: Column) -> Column:
    return (F.unix_date(d) + JULIAN_EPOCH).cast("long")


def date_of_julian(j: Column) -> Column:
    return F.date_from_unix_date((j - JULIAN_EPOCH).cast("int"))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def week_string(d: Column) -> Column:
    return F.concat(_year4(iso_year(d)), F.lit("-W"), _two(F.weekofyear(d)))


def month_string(d: Column) -> Column:
    return F.concat(_year4(F.year(d)), F.lit("-"), _two(F.month(d)))


def yearday_string(d: Column) -> Column:
    return F.concat(_year4(F.year(d)), F.lit("-"), F.lpad(F.dayofyear(d).cast("string"), 3, "0"))


def weekday(d: Column) -> Column:
    return F.weekday(d) + 1


#: Parts that EXTRACT knows: name -> (kind of the result, expression of a date).
PARTS = {
    "YEAR": ("int", F.year),
    "MONTH": ("int", F.month),
    "DAY": ("int", F.dayofmonth),
    "WEEK": ("int", F.weekofyear),
    "WEEKYEAR": ("int", iso_year),
    "WEEKDAY": ("int", weekday),
    "YEARDAY": ("int", F.dayofyear),
    "HEYEAR": ("int", lambda d: F.year(d) + 10000),
    "MILLENNIUM": ("int", lambda d: F.floor(F.year(d) / 1000)),
    "CENTURY": ("int", lambda d: F.floor(F.year(d) / 100)),
    "DECADE": ("int", lambda d: F.floor(F.year(d) / 10)),
    "QUARTER": ("int", F.quarter),
    "JULIAN": ("int", julian),
    "DATE": ("string", format_date),
    "DATETIME": ("string", lambda d: F.concat(format_date(d), F.lit("T00:00:00"))),
    "MONTH_STRING": ("string", month_string),
    "WEEK_STRING": ("string", week_string),
    "YEARDAY_STRING": ("string", yearday_string),
}

#: Columns of the CALENDAR table: name -> (kind, expression of a date).
CALENDAR = {
    "julian": ("int", julian),
    "date": ("date", lambda d: d),
    "year": ("int", F.year),
    "month": ("int", F.month),
    "day": ("int", F.dayofmonth),
    "weekyear": ("int", iso_year),
    "week": ("int", F.weekofyear),
    "weekday": ("int", weekday),
    "yearday": ("int", F.dayofyear),
    "millenium": ("int", PARTS["MILLENNIUM"][1]),
    "century": ("int", PARTS["CENTURY"][1]),
    "decade": ("int", PARTS["DECADE"][1]),
    "quarter": ("int", F.quarter),
    "firstOfYear": ("date", lambda d: F.trunc(d, "year")),
    "lastOfYear": ("date", lambda d: F.make_date(F.year(d), F.lit(12), F.lit(31))),
    "firstOfQuarter": ("date", lambda d: F.trunc(d, "quarter")),
    "lastOfQuarter": ("date", lambda d: F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1)))),
    "firstOfMonth": ("date", lambda d: F.trunc(d, "month")),
    "lastOfMonth": ("date", F.last_day),
    "firstOfWeek": ("date", lambda d: F.trunc(d, "week")),
    "lastOfWeek": ("date", lambda d: F.date_add(F.trunc(d, "week"), 6)),
    "isLeapYear": ("int", lambda d: (F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366).cast("int")),
    "weekdayInMonth": ("int", lambda d: F.floor((F.dayofmonth(d) - 1) / 7) + 1),
    "isWeekend": ("int", lambda d: (weekday(d) >= 6).cast("int")),
    "monthString": ("string", month_string),
    "ordinalDate": ("string", yearday_string),
    "weekString": ("string", week_string),
    "weekDate": ("string", lambda d: F.concat(week_string(d), F.lit("-"), weekday(d).cast("string"))),
}

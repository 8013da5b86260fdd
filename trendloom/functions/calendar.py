"""Seasons, shifted days and calendars as column expressions.

A day of a real calendar is a DATE. Models also run on calendars that no DATE can hold (30 February, years of 360 days), so there a day
is a whole number, the days since the start of 1970 in the row's own calendar, and goes with a column that names the calendar.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The months of each season, and the days of a year in each calendar.
SEASONS = {"all": tuple(range(1, 13)), "cool": (4, 5, 6, 7, 8, 9, 10), "warm": (11, 12, 1, 2, 3)}
YEAR_DAYS = {"360_day": 360.0, "noleap": 365.0, "365_day": 365.0, "all_leap": 366.0, "366_day": 366.0}
DEFAULT_YEAR_DAYS = 365.25
#: The names of calendars whose days are real dates.
REAL = ("standard", "gregorian", "proleptic_gregorian")
#: The seconds of each unit in which a time axis may count.
UNIT_SECONDS = {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}


def season_name(season: str | None) -> str:
    if season is None:
        return "all"
    if season not in SEASONS:
        raise ValueError(f"season must be one of {', '.join(SEASONS)}, not {season!r}")
    return season


def in_season(day: Column, season: str | None, calendar: Column | None = None) -> Column:
    """day: a DATE, or with a calendar the number of a day in it."""
    month = F.month(day) if calendar is None else date_parts(day, calendar)["month"]
    return month.isin(*SEASONS[season_name(season)])


def season_year(day: Column, season: str | None, calendar: Column | None = None) -> Column:
    """The calendar year; a warm season belongs to the year in which it ends."""
    parts = None if calendar is None else date_parts(day, calendar)
    year, month = (F.year(day), F.month(day)) if parts is None else (parts["year"], parts["month"])
    return year + (month >= 11).cast("int") if season_name(season) == "warm" else year


def half_year(day: Column) -> Column:
    return F.when(in_season(day, "cool"), F.lit("cool")).otherwise(F.lit("warm"))


def shifted_day(ts: Column, hours: int) -> Column:
    """The day on which a moment falls after a shift by whole hours."""
    return F.to_date(F.timestamp_add("HOUR", F.lit(hours), ts))


def year_length(calendar: Column) -> Column:
    """Days of a year in a calendar; a name that is not known, and null, give the mean Gregorian year."""
    table = F.create_map(*[F.lit(x) for pair in YEAR_DAYS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, calendar), F.lit(DEFAULT_YEAR_DAYS))


def known_calendar(calendar: Column) -> Column:
    """The name in lower case; an error for one that is not known. Null is the standard calendar."""
    name = F.lower(F.coalesce(calendar, F.lit("standard")))
    unknown = F.raise_error(F.concat(F.lit("unknown calendar: "), name)).cast("string")
    return F.when(name.isin(*REAL, *YEAR_DAYS), name).otherwise(unknown)


def month_starts(days: int) -> list[int]:
    """Days of the year before each month, in a year of 360, 365 or 366 days."""
    lengths = [30] * 12 if days == 360 else [31, days - 337, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return [0, *accumulate(lengths[:-1])]


def _starts(days: Column) -> Column:
    tables = [F.array(*map(F.lit, month_starts(n))) for n in (360, 365, 366)]
    return F.when(days == 360, tables[0]).when(days == 365, tables[1]).otherwise(tables[2])


def _is_real(calendar: Column) -> Column:
    return F.lower(F.coalesce(calendar, F.lit("standard"))).isin(*REAL)


def _fixed_days(calendar: Column) -> Column:
    return year_length(F.lower(calendar)).cast("int")


def day_number(year: Column, day_of_year: Column, calendar: Column) -> Column:
    """The number of a day, the first day of 1970 being 0; in real calendars that of the DATE."""
    fixed = (year - 1970) * _fixed_days(calendar) + day_of_year - 1
    return F.when(_is_real(calendar), F.unix_date(F.make_date(year, F.lit(1), F.lit(1))) + day_of_year - 1).otherwise(fixed).cast("int")


def date_number(year: Column, month: Column, day: Column, calendar: Column) -> Column:
    """The number of a day given by its month; null for a day that the calendar doesn't have."""
    days = _fixed_days(calendar)
    starts = _starts(days)
    before = F.element_at(starts, month)
    length = F.when(month < 12, F.try_element_at(starts, month + 1)).otherwise(days) - before
    fixed = F.when(day.between(1, length), (year - 1970) * days + before + day - 1)
    real = F.when(day.between(1, F.day(F.last_day(F.make_date(year, month, F.lit(1))))), F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1)
    return F.when(month.between(1, 12), F.when(_is_real(calendar), real).otherwise(fixed)).cast("int")


def date_parts(number: Column, calendar: Column) -> Column:
    """struct<year, month, day, doy> of a day's number in its calendar."""
    days, date = _fixed_days(calendar), F.date_from_unix_date(number)
    left = F.pmod(number, days)
    starts = _starts(days)
    month = F.size(F.filter(starts, lambda s: s <= left))
    pick = lambda real, fixed: F.when(_is_real(calendar), real).otherwise(fixed).cast("int")
    return F.struct(pick(F.year(date), 1970 + F.floor(number / days)).alias("year"), pick(F.month(date), month).alias("month"),
                    pick(F.day(date), left - F.element_at(starts, month) + 1).alias("day"), pick(F.dayofyear(date), left + 1).alias("doy"))


def date_text(number: Column, calendar: Column) -> Column:
    """YYYY-MM-DD, for any calendar."""
    parts = date_parts(number, calendar)
    return F.format_string("%04d-%02d-%02d", parts["year"], parts["month"], parts["day"])


def decoded_time(value: Column, units: str, calendar: Column) -> Column:
    """struct<day, second> of a number on a time axis such as `days since 1850-01-01 12:00`, counted in the calendar. A moment
    within half a millisecond of a whole second is that second, as fractions of days are not exact. Null stays null."""
    words = units.strip().split(None, 2)
    unit = words[0].lower().removesuffix("s") if len(words) == 3 and words[1].lower() == "since" else ""
    if unit not in UNIT_SECONDS:
        raise ValueError(f"not the units of a time axis: {units!r}")
    date, _, clock = words[2].replace("T", " ").partition(" ")
    year, month, day = map(int, date.split("-"))
    clock = [float(x) for x in clock.replace("Z", "").replace("UTC", "").strip().split(":") if x]
    first = int(sum(x * s for x, s in zip(clock, (3600, 60, 1))))
    start = date_number(F.lit(year), F.lit(month), F.lit(day), calendar)
    # whole units and their rest apart, so that no large number of seconds loses its last digits
    whole = F.floor(value)
    rest = (value - whole) * UNIT_SECONDS[unit]
    rest = F.when(F.abs(rest - F.round(rest)) < 5e-4, F.round(rest)).otherwise(F.floor(rest)).cast("long")
    seconds = whole.cast("long") * UNIT_SECONDS[unit] + rest + first
    return F.struct((start + F.floor(seconds / 86_400)).cast("int").alias("day"), F.pmod(seconds, F.lit(86_400)).cast("int").alias("second"))

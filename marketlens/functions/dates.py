"""Date functions as Columns over DATE and TIMESTAMP; serial numbers only at the edges."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Day numbers of 1970-01-01 with the 1900 and the 1904 base.
EPOCH_1900, EPOCH_1904 = 25569, 24107


def serial_to_timestamp(n: Column, base: int = 1900) -> Column:
    """Serial day number to a UTC timestamp; under 60 the 1900 base is shifted by its false leap day."""
    epoch = F.lit(EPOCH_1904) if base == 1904 else F.when(n < 60, EPOCH_1900 - 1).otherwise(EPOCH_1900)
    return F.timestamp_seconds(F.round((n - epoch) * 86400).cast("bigint"))


def timestamp_to_serial(ts: Column, base: int = 1900) -> Column:
    day = F.datediff(ts, F.lit("1970-01-01").cast("date"))
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400
    epoch = F.lit(EPOCH_1904) if base == 1904 else F.when(day < 60 - EPOCH_1900, EPOCH_1900 - 1).otherwise(EPOCH_1900)
    return day + epoch + clock


def date(y: Column, m: Column, d: Column) -> Column:
    """Date from parts; months and days beyond their range roll on, years under 1900 count from 1900."""
    year = F.when(y < 1900, y + 1900).otherwise(y)
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), (m - 1).cast("int"))
    return F.when(y >= 0, F.date_add(first, (d - 1).cast("int")))


# Date notations that DATEVALUE reads, in order.
DATE_NOTATIONS = ("yyyy-M-d", "yyyy/M/d", "d-MMM-yyyy", "d MMM yyyy", "M/d/yyyy")


def datevalue(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("date") for p in DATE_NOTATIONS])


def time(h: Column, m: Column, s: Column) -> Column:
    """Fraction of a day; seconds and minutes roll over, whole days are dropped."""
    seconds = h * 3600 + m * 60 + s
    return F.when(seconds >= 0, F.pmod(seconds, F.lit(86400)) / 86400)


def timevalue(text: Column) -> Column:
    ts = F.coalesce(F.try_to_timestamp(text, F.lit("H:m:s")), F.try_to_timestamp(text, F.lit("H:m")))
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def datedif(start: Column, end: Column, unit: str = "D") -> Column:
    """Difference in D, M, Y, MD, YM or YD; null unless start is before end."""
    sd, ed = F.dayofmonth(start), F.dayofmonth(end)
    sm, em = F.month(start), F.month(end)
    years = F.year(end) - F.year(start)
    if unit == "D":
        value = F.datediff(end, start)
    elif unit == "M":
        value = years * 12 + em - sm - (ed < sd).cast("int")
    elif unit == "Y":
        value = years - ((em < sm) | ((em == sm) & (ed < sd))).cast("int")
    elif unit == "MD":
        before = F.dayofmonth(F.date_sub(F.to_date(end), ed))
        value = F.when(ed < sd, ed + F.greatest(before - sd, F.lit(0))).otherwise(ed - sd)
    elif unit == "YM":
        value = F.pmod(em - sm, F.lit(12)) - (ed < sd).cast("int")
    elif unit == "YD":
        # The end moves back by whole years to the year of the start; 29 Feb becomes 1 Mar there.
        leap_day = (em == 2) & (ed == 29) & ~is_leap(F.year(start))
        moved = F.when(leap_day, F.make_date(F.year(start), F.lit(3), F.lit(1))).otherwise(
            F.add_months(F.to_date(end), (-12 * years).cast("int")))
        gap = F.dayofyear(moved) - F.dayofyear(start)
        value = F.when(years > 0, F.when(gap < 0, gap + 365).otherwise(gap)).otherwise(F.datediff(end, start))
    else:
        raise ValueError(f"unknown unit {unit}")
    return F.when(F.to_date(start) < F.to_date(end), value)


def days360(start: Column, end: Column, european: bool = False) -> Column:
    sd, sm, sy = F.dayofmonth(start), F.month(start), F.year(start)
    ed, em, ey = F.dayofmonth(end), F.month(end), F.year(end)
    from_day = F.least(sd, F.lit(30))
    if not european:
        from_day = F.when((sm == 2) & (sd == F.dayofmonth(F.last_day(start))), 30).otherwise(from_day)
        # The 31st is the 1st of the next month where the start is before the 30th: one day more than the 30th.
        to_day = F.when((ed == 31) & (from_day == 30), 30).otherwise(ed)
    else:
        to_day = F.least(ed, F.lit(30))
    return (to_day + em * 30 + ey * 360) - (from_day + sm * 30 + sy * 360)


def _leap_years_to(year: Column) -> Column:
    return F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400)


def yearfrac(start: Column, end: Column, basis: int = 0) -> Column:
    if basis == 0:
        return days360(start, end) / 360
    if basis == 4:
        return days360(start, end, european=True) / 360
    days = datedif(start, end, "D")
    if basis == 2:
        return days / 360
    if basis == 3:
        return days / 365
    sy, ey = F.year(start), F.year(end)
    late = (F.month(end) * 100 + F.dayofmonth(end)) >= 229
    early = F.month(start) < 3
    flag = lambda test: test.cast("int")
    spanned = ey - sy + 1
    between = F.greatest(_leap_years_to(ey - 1) - _leap_years_to(sy), F.lit(0))
    leap_days = flag(early & is_leap(sy)) + between + flag(late & is_leap(ey))
    long_pair = (spanned == 2) & (leap_days == 0) & is_leap(sy) & (days > 365)
    leap_days = F.when(long_pair, 1).otherwise(leap_days)
    years = F.when((spanned == 2) & ~long_pair & (days < 366), 1).otherwise(spanned)
    share = F.when(spanned == 1, flag(is_leap(ey) & (early | late)).cast("double")).otherwise(F.try_divide(leap_days.cast("double"), years))
    return days / (365 + share)


def _holidays(days: Sequence[dt.date]) -> list[dt.date]:
    return sorted({d for d in days if d.weekday() < 5})


def _weekdays_to(d: Column) -> Column:
    """Monday-to-Friday days from a fixed Monday (1899-12-25) up to and with the date."""
    n = F.datediff(d, F.lit(dt.date(1899, 12, 25)))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def _holidays_to(d: Column, free: Sequence[dt.date]) -> Column:
    """Holidays up to and with the date: one look into an array with an entry per day of the holiday span."""
    counts, seen = [], 0
    for day in range((free[-1] - free[0]).days + 1):
        seen += free[0] + dt.timedelta(days=day) == free[seen] if seen < len(free) else 0
        counts.append(seen)
    place = F.datediff(d, F.lit(free[0]))
    found = F.get(F.expr("array(" + ",".join(map(str, counts)) + ")"), F.least(place, F.lit(len(counts) - 1)))
    return F.when(place < 0, 0).otherwise(found)


def networkdays(start: Column, end: Column, holidays: Sequence[dt.date] = ()) -> Column:
    """Working days from start to end, both included; negative where end is before start."""
    a, b = F.least(F.to_date(start), F.to_date(end)), F.greatest(F.to_date(start), F.to_date(end))
    count = _weekdays_to(b) - _weekdays_to(F.date_sub(a, 1))
    free = _holidays(holidays)
    if free:
        count = count - (_holidays_to(b, free) - _holidays_to(F.date_sub(a, 1), free))
    return F.when(F.to_date(start) > F.to_date(end), -count).otherwise(count)


def _weekdays_on(d: Column, n: Column | int, ahead: bool) -> Column:
    """The weekday ``n`` weekdays ahead (n positive) or back (n negative).

    Weekends count as their Friday (ahead) or Monday (back), so that the first step lands on a weekday.
    """
    dow = F.weekday(d)
    if ahead:
        place = F.least(dow, F.lit(4)) + n
        return F.date_add(F.date_sub(d, dow), (F.floor(place / 5) * 7 + place % 5).cast("int"))
    base = F.date_add(d, F.when(dow > 4, 7 - dow).otherwise(0))
    left = 4 - F.when(dow > 4, 0).otherwise(dow)
    place = left - n
    return F.date_sub(F.date_add(base, left), (F.floor(place / 5) * 7 + place % 5).cast("int"))


def workday(start: Column, days: Column | int, holidays: Sequence[dt.date] = ()) -> Column:
    """The date ``days`` working days after (negative: before) the start; fractions of days are rounded down.

    Weekdays by arithmetic; then the holidays between start and result are passed in
    order, each moving the result one weekday on.
    """
    start, free = F.to_date(start), _holidays(holidays)

    def moved(ahead: bool) -> Column:
        found = _weekdays_on(start, days, ahead)
        if not free:
            return found
        ordered = F.array(*[F.lit(h) for h in (free if ahead else reversed(free))])
        passed = (lambda h, d: (h > start) & (h <= d)) if ahead else (lambda h, d: (h < start) & (h >= d))
        return F.aggregate(ordered, found, lambda d, h: F.when(passed(h, d), _weekdays_on(d, 1 if ahead else -1, ahead)).otherwise(d))

    if isinstance(days, Column):
        days = F.floor(days).cast("int")
        return F.when(days == 0, start).when(days > 0, moved(True)).when(days < 0, moved(False))
    return moved(days > 0) if days else start


def day(d: Column) -> Column: return F.dayofmonth(d)
def month(d: Column) -> Column: return F.month(d)
def year(d: Column) -> Column: return F.year(d)
def hour(d: Column) -> Column: return F.hour(d)
def minute(d: Column) -> Column: return F.minute(d)
def second(d: Column) -> Column: return F.second(d)


def weekday(d: Column, style: int = 1) -> Column:
    """1: Sunday = 1; 2: Monday = 1; 3: Monday = 0."""
    return {1: F.dayofweek(d), 2: F.weekday(d) + 1, 3: F.weekday(d)}[style]


def weeknum(d: Column, method: int = 1) -> Column:
    """Week of the year, week 1 holds 1 January; weeks start on Sunday (1) or Monday (2).

    With Monday weeks, a 1 January on a Sunday is week 0.
    """
    first = F.dayofweek(F.trunc(d, "year")) - 1
    in_first_week = 7 - (first + 2 - method) % 7
    return (F.ceil((F.dayofyear(d) - 1 - in_first_week) / 7) + 1).cast("int")


def now() -> Column: return F.current_timestamp()
def today() -> Column: return F.current_date()
def edate(d: Column, months) -> Column: return F.add_months(F.to_date(d), months)
def eomonth(d: Column, months) -> Column: return F.last_day(F.add_months(F.to_date(d), months))

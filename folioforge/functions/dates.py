"""Dates in many notations, recency, and run windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Notations in the order in which they are tried: pattern, groups of year, month, day.
NOTATIONS = [
    (r"([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})", 3),
    (r"([0-9]{4})[-./]([0-9]{1,2})(?![0-9])", 2),
    (r"([0-9]{4})([0-9]{2})([0-9]{2})", 3),
    (r"([0-9]{4})년\s*([0-9]{1,2})월\s*(?:([0-9]{1,2})일)?", 3),
    (r"^([0-9]{4})$", 1),
]


def _clamped(year: Column, month: Column, day: Column) -> Column:
    """A valid date: month into 1..12, day down to the month's last; null for year 0."""
    month = F.least(F.greatest(month, F.lit(1)), F.lit(12))
    first = F.when(year.between(1, 9999), F.make_date(year, month, F.lit(1)))
    return F.date_add(first, F.least(F.greatest(day, F.lit(1)), F.day(F.last_day(first))) - 1)


def parse_date(c: Column) -> Column:
    """A string in any of the notations; missing months and days count as 1, days beyond a month's end
    as its last.  The written day is taken, no time zone applied.  Null for anything else."""
    text = F.trim(c)
    part = lambda p, g: F.regexp_extract(text, p, g).try_cast("int")
    tried = []
    for pattern, groups in NOTATIONS:
        get = lambda g: F.coalesce(part(pattern, g), F.lit(1)) if g <= groups else F.lit(1)  # noqa: B023, E731
        tried.append(F.when(F.regexp_like(text, F.lit(pattern)), _clamped(part(pattern, 1), get(2), get(3))))
    iso = F.when(F.regexp_like(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ].*)?$")), F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd"))
    iso = F.when(F.year(iso) >= 1, iso)
    return F.coalesce(iso, *tried)


def date_from_parts(parts: Column) -> Column:
    """[year[, month[, day]]]; null if that is no valid date."""
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(1))
    first = F.when(F.get(parts, 0).between(1, 9999) & at(1).between(1, 12), F.make_date(F.get(parts, 0), at(1), F.lit(1)))
    return F.when(at(2).between(1, F.day(F.last_day(first))), F.date_add(first, at(2) - 1))


def in_window(day: Column, since, until) -> Column:
    """Inclusive on both ends; a null date passes."""
    return day.isNull() | day.between(since, until)


#: Fixed values: (days at most, share) of the recency score, and the shares beyond and without a date.
RECENCY = [(30, 1.0), (90, 0.85), (180, 0.7), (365, 0.55), (1095, 0.35)]
OLD, UNDATED = 0.15, 0.4


def recency(day: Column, today: Column) -> Column:
    age = F.datediff(today, day)
    out = F.lit(OLD)
    for days, share in reversed(RECENCY):
        out = F.when(age <= days, share).otherwise(out)
    return F.when(day.isNull(), UNDATED).otherwise(out)

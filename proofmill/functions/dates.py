"""Dates as printed, day first (DAT-1 to DAT-10). Failed parses are null; the reference day is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and patterns of dates.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = rf"({'|'.join(MONTHS)})[a-z]*\.?"
ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
DAY_FIRST = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH}[\s,.-]+(\d{{4}})\b"
MONTH_FIRST = rf"(?i)\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
NUMERIC = r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b"
RELATIVE = r"(?i)\b(\d+|an?)\s+(minute|hour|day|week|month|year)s?\s+ago\b"


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def month_number(word: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(word, F.lit(3)))).cast("string")


def absolute_date(text: Column) -> Column:
    """The first pattern that matches decides, even if its date doesn't exist."""
    g = lambda p, i: F.regexp_extract(text, p, i)
    return (
        F.when(text.rlike(ISO), _date(g(ISO, 1), g(ISO, 2), g(ISO, 3)))
        .when(text.rlike(DAY_FIRST), _date(g(DAY_FIRST, 3), month_number(g(DAY_FIRST, 2)), g(DAY_FIRST, 1)))
        .when(text.rlike(MONTH_FIRST), _date(g(MONTH_FIRST, 3), month_number(g(MONTH_FIRST, 1)), g(MONTH_FIRST, 2)))
        .when(text.rlike(NUMERIC), _date(g(NUMERIC, 3), g(NUMERIC, 2), g(NUMERIC, 1)))
    )


def minus_months(day: Column, n: Column) -> Column:
    return F.add_months(day, -n)


def relative_date(text: Column, today: Column) -> Column:
    count = F.when(F.lower(F.regexp_extract(text, RELATIVE, 1)).isin("a", "an"), 1).otherwise(F.regexp_extract(text, RELATIVE, 1).try_cast("int"))
    unit = F.lower(F.regexp_extract(text, RELATIVE, 2))
    return (
        F.when(text.rlike(r"(?i)\byesterday\b"), F.date_sub(today, 1))
        .when(~text.rlike(RELATIVE), None)
        .when(unit.isin("minute", "hour"), today)
        .when(unit == "day", F.date_sub(today, count))
        .when(unit == "week", F.date_sub(today, count * 7))
        .when(unit == "year", minus_months(today, count * 12))
        .otherwise(minus_months(today, count))
    )


def parse_date(text: Column, today: Column) -> Column:
    return F.coalesce(absolute_date(text), relative_date(text, today))


def item_date(iso: Column, text: Column, today: Column) -> Column:
    """An item's ISO field wins, even if it holds no date; else its date text."""
    return F.when(F.length(iso) >= 10, F.left(iso, F.lit(10)).try_cast("date")).otherwise(parse_date(text, today))


def order_month(url: Column) -> Column:
    """First day of the month in a path like /enforcement/orders/mar-2024/."""
    pattern = rf"(?i)/enforcement/orders/({'|'.join(MONTHS)})-(\d{{4}})/"
    return F.when(url.rlike(pattern), _date(F.regexp_extract(url, pattern, 2), month_number(F.regexp_extract(url, pattern, 1)), F.lit("1")))


def matter_date(title: Column, url: Column) -> Column:
    return F.coalesce(absolute_date(title), order_month(url))


def calendar_months(a: Column, b: Column) -> Column:
    """Months from a to b by calendar, whatever the day."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def in_time(when: Column, cutoff: Column) -> Column:
    """Dated on or before the cutoff; without a cutoff everything counts, undated too (FLT-9)."""
    return cutoff.isNull() | F.coalesce(when <= cutoff, F.lit(False))


def in_month(month: Column, cutoff: Column) -> Column:
    return in_time(month, F.trunc(cutoff, "MM"))


def choose_cutoff(given: Column, point_in_time: Column, cover: Column) -> Column:
    return F.coalesce(given, F.when(point_in_time, cover))

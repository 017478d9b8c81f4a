"""Review dates are calendar days; nothing here depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewops.fixed_values import DATE_FORMATS
from reviewops.functions.text import strip


def parse_date(text: Column) -> Column:
    """Text to DATE, trying the accepted formats in order; NULL if none fits.

    A format can only match text that holds its separator, so each row tries the
    one or two formats its separator allows instead of failing through all five.
    """
    t = strip(text)
    us, iso, eu, long_comma, long_plain = (F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATE_FORMATS)
    return (F.when(t.contains("/"), F.coalesce(us, eu))
            .when(t.contains("-"), iso)
            .when(t.contains(","), long_comma)
            .when(t.contains(" "), long_plain))


def load_date(text: Column) -> Column:
    """Text of an export to DATE: what ``parse_date`` reads, and dates written in other usual ways.

    Years come first in 2017-08-03, 2017/8/3, 2017.08.03 and 20170803, month names may be short or long and
    with or without a comma. A time of day and an offset behind the date are dropped: the day
    is the one written. Numbers with the year last are month first where that is a date.
    """
    t = strip(text)
    day = F.regexp_replace(t, r"[T\s]+\d{1,2}:\d{2}.*$", "")
    year_first = F.regexp_replace(F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$", "$1-$2-$3")
    numbers = F.regexp_replace(day, r"^(\d{1,2})[.-](\d{1,2})[.-](\d{4})$", "$1/$2/$3")
    named = F.regexp_replace(F.regexp_replace(F.initcap(day), r"([A-Z][a-z]{2})[a-z]*\.?", "$1"), r"[,\s-]+", " ")

    def read(value: Column, pattern: str) -> Column:
        return F.try_to_timestamp(value, F.lit(pattern)).cast("date")

    return (F.when(day.rlike(r"^\d{4}[/.-]|^\d{8}$"), read(year_first, "yyyy-M-d"))
            .when(day.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}$"), F.coalesce(read(numbers, "M/d/yyyy"), read(numbers, "d/M/yyyy")))
            .when(day.rlike(r"^[A-Za-z]"), read(named, "MMM d yyyy"))
            .otherwise(read(named, "d MMM yyyy")))


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def range_label(first: Column, last: Column) -> Column:
    return F.concat(F.date_format(first, "MMM yyyy"), F.lit(" – "), F.date_format(last, "MMM yyyy"))


def calendar_months_between(first: Column, last: Column) -> Column:
    """Whole calendar months from first to last, never negative."""
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    return F.when(months < 0, 0).otherwise(months)


def months_before(day: Column, months: int) -> Column:
    return F.add_months(day, -months)

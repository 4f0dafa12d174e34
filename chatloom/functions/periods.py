"""Calendar periods: week, two weeks, month, quarter, year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.schemas import SPLITS


def lenient_date(timestamp: Column) -> Column:
    """The day of YYYY-MM-DD…; months and days out of range roll over instead of failing."""
    part = lambda i: F.regexp_extract(timestamp, r"^(\d{4})-(\d{1,2})-(\d{1,2})", i)
    num = lambda i: F.when(part(i) != "", part(i).cast("int"))
    return F.date_add(F.add_months(F.make_date(num(1), F.lit(1), F.lit(1)), num(2) - 1), num(3) - 1)


def period_bounds(d: Column, interval: str) -> tuple[Column, Column]:
    """First and last day of the period of day d."""
    monday = F.date_trunc("week", d).cast("date")
    if interval == "1w":
        return monday, F.date_add(monday, 6)
    if interval == "2w":
        jan1 = F.date_trunc("year", monday).cast("date")
        off = F.when(F.dayofweek(jan1) == 1, -6).otherwise(3 - F.dayofweek(jan1))
        n = F.ceil((F.datediff(monday, jan1) + off) / 7)
        even = n % 2 == 0
        return F.when(even, F.date_add(monday, -7)).otherwise(monday), F.when(even, F.date_add(monday, 6)).otherwise(F.date_add(monday, 13))
    if interval == "1mo":
        return F.trunc(d, "MM"), F.last_day(d)
    if interval == "3mo":
        start = F.trunc(d, "quarter")
        return start, F.last_day(F.add_months(start, 2))
    if interval == "1y":
        return F.trunc(d, "year"), F.make_date(F.year(d), F.lit(12), F.lit(31))
    raise ValueError(f"interval must be one of {SPLITS}")


def period_label(d: Column, interval: str) -> Column:
    start, end = period_bounds(d, interval)
    return F.concat(F.date_format(start, "yyyy.MM.dd"), F.lit("-"), F.date_format(end, "yyyy.MM.dd"))


def period_boundaries(start: Column, end: Column, interval: str, cap: int = 10_000) -> Column:
    """Array of the distinct labels of all days from start to end, in order, at most ``cap``."""
    labels = F.transform(F.sequence(start, end, F.expr("interval 1 day")), lambda d: period_label(d, interval))
    return F.slice(F.array_distinct(labels), 1, cap)


def day_header(d: Column) -> Column:
    # Weekday labels from Sunday on.
    names = F.array(*[F.lit(x) for x in ("dom", "seg", "ter", "qua", "qui", "sex", "sáb")])
    return F.concat(F.date_format(d, "dd/MM"), F.lit(" "), F.element_at(names, F.dayofweek(d)))

"""Periods and calendar buckets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def _edge(c: Column, last: bool) -> Column:
    """First or last day of YYYY, YYYY-MM or YYYY-MM-DD; null if it is none."""
    c = F.regexp_replace(F.trim(c), "^~", "")
    year = F.when(c.rlike(r"^\d{4}$"), F.try_to_date(F.concat(c, F.lit("-12-31" if last else "-01-01")), "yyyy-MM-dd"))
    first = F.when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd"))
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.coalesce(year, F.last_day(first) if last else first, day)


def period_interval(c: Column) -> Column:
    """struct(first, last) of a period: a day, month or year, a/b, or a/.. without an end; null if unparseable."""
    parts = F.split(c, "/")
    two = F.size(parts) == 2
    end = F.get(parts, F.when(two, F.lit(1)).otherwise(F.lit(0)))
    last = F.when(two & F.trim(end).isin("", ".."), F.lit(OPEN_END).cast("date")).otherwise(_edge(end, True))
    first = _edge(F.get(parts, F.lit(0)), False)
    return F.when(first.isNotNull() & last.isNotNull() & (F.size(parts) <= 2), F.struct(first.alias("first"), last.alias("last")))


def overlaps(a: Column, b: Column) -> Column:
    return (a["first"] <= b["last"]) & (b["first"] <= a["last"])


def grain_bucket(ts: Column, eras: list[tuple[int, str]], default: str) -> Column:
    """YYYY or YYYY-MM by the first era whose last year is not before the row's."""
    grain = F.lit(default)
    for until, name in sorted(eras, reverse=True):
        grain = F.when(F.year(ts) <= until, F.lit(name)).otherwise(grain)
    return F.when(grain == "year", F.date_format(ts, "yyyy")).otherwise(F.date_format(ts, "yyyy-MM"))

"""Date and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours from start to end, cut towards zero and signed; null if either is null."""
    return F.timestamp_diff("HOUR", start, end)


def fractional_hours(start: Column, end: Column) -> Column:
    """Hours from start to end with their fraction."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3_600_000_000.0)


def is_weekend(day: Column) -> Column:
    """1 for Saturday and Sunday, else 0."""
    return F.when(F.dayofweek(day).isin(1, 7), 1).otherwise(0)


def calendar(day: Column, full: bool = False) -> list[Column]:
    """day_of_week (Sunday is 1), month and is_weekend; with full also day_of_year and week_of_year (ISO)."""
    more = [F.dayofyear(day).alias("day_of_year"), F.weekofyear(day).alias("week_of_year")] if full else []
    return [F.dayofweek(day).alias("day_of_week"), F.month(day).alias("month"), *more, is_weekend(day).alias("is_weekend")]


def created_hour(created: Column, fallback: Column) -> Column:
    """Hour of a timestamp, or the fallback column where it is missing."""
    return F.coalesce(F.hour(created), fallback.try_cast("int"))

"""Selection of changed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest order value; rows without a key go, nulls order last, ties by content.

    Each key's greatest value comes from an aggregate that is combined before its shuffle, by hash where the type is of
    fixed width. Only rows with that value (a key's last and its ties) are ordered.
    """
    rows = df.filter(F.col(key).isNotNull())
    best = rows.groupBy(F.col(key).alias("__key")).agg(F.max(order).alias("__best"))
    last = rows.join(best, (F.col(key) == F.col("__key")) & F.col(order).eqNullSafe(F.col("__best")))
    ties = Window.partitionBy(key).orderBy(F.desc(F.xxhash64(*df.columns)))
    return last.withColumn("__nth", F.row_number().over(ties)).filter("__nth = 1").select(*df.columns)


def recent(df: DataFrame, column: str, days: int, today: Column) -> DataFrame:
    return df.filter(F.col(column) >= F.date_sub(today, days))


def since(df: DataFrame, column: str, moment: Column) -> DataFrame:
    return df.filter(F.col(column) > moment)


def changed_since(df: DataFrame, columns: list[str], moment: Column) -> DataFrame:
    """Rows with any of the columns after a moment; each comparison can be pushed to the scan."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c) > moment for c in columns]))


def date_range(df: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """Half-open: from start up to, not including, end."""
    return df.filter((F.col(column) >= start) & (F.col(column) < end))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)

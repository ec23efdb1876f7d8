"""Clustering of a table's files along a space-filling curve, so that a filter on any of the columns skips files."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from servista.functions.ranges import place

#: Ranges of a column are 2**BITS at most; their bounds come from so many sampled values.
BITS, SAMPLE = 6, 20_000


def bounds(df: DataFrame, column: str, bits: int = BITS) -> list[Any]:
    """Distinct values between ranges of about as many rows each, from a sample of bounded size; nulls are left out."""
    rows = df.select(column).filter(F.col(column).isNotNull())
    n = rows.count()
    values = sorted(r[0] for r in rows.sample(min(1.0, SAMPLE / max(n, 1)), seed=7).limit(2 * SAMPLE).collect())
    step = len(values) / 2**bits
    return sorted({values[int(step * i)] for i in range(1, 2**bits)} - set(values[:1])) if values else []


def range_id(column: str, between: list[Any], bits: int = BITS) -> Column:
    """The number of a value's range, spread over all of 0 to 2**bits - 1; nulls have 0."""
    if not between:
        return F.lit(0)
    n = place(F.col(column), [F.lit(b) for b in between])
    return F.when(F.col(column).isNull(), 0).otherwise(F.floor(n * (2**bits - 1) / len(between))).cast("int")


def z_order(ids: list[Column], bits: int = BITS) -> Column:
    """The ids' bits in turn, the most significant ones first."""
    z = F.lit(0).cast("long")
    for b in range(bits):
        for j, c in enumerate(reversed(ids)):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)).cast("long"), b * len(ids) + j))
    return z


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int) -> None:
    """Write df into about so many files, rows near to each other in all columns together; ranges are even, whatever is frequent."""
    z = z_order([range_id(c, bounds(df, c)) for c in columns])
    rows = df.withColumn("__z", z)
    rows.repartitionByRange(files, "__z", *columns).sortWithinPartitions("__z", *columns).drop("__z").write.parquet(path)


def file_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each file that df reads: rows, and the least and greatest value of each column."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def files_read(ranges: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """For each of the values (one column, few rows): the files whose range holds it, of all files."""
    own = values.select(F.col(column).alias("value")).distinct()
    inside = F.col("value").between(F.col(f"min_{column}"), F.col(f"max_{column}"))
    total = ranges.agg(F.count("*").alias("files"))
    return ranges.join(F.broadcast(own), inside).groupBy("value").agg(F.count("*").alias("files_read")).crossJoin(F.broadcast(total))

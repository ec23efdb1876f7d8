"""Daily aggregates that add up: exact distinct counts and percentiles of any longer period from stored days, not from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Size parameter of the quantile sketches: memory a sketch, about 1.5 / K**0.9 of rank error.
K = 800


def daily_sets(df: DataFrame, day: Column, id_: Column, by: list[str] | None = None) -> DataFrame:
    """date, by, bucket and a bitmap of the ids (whole numbers) seen: one row for each 32,768 neighbouring ids of a day that occur."""
    rows = df.select(day.alias("date"), *(by or []), id_.cast("long").alias("id")).filter("id IS NOT NULL")
    return rows.groupBy("date", *(by or []), F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))


def distinct_ids(sets: DataFrame, *by: Column | str) -> DataFrame:
    """by and n, the exact number of distinct ids, of stored daily sets."""
    named = [F.col(c) if isinstance(c, str) else c for c in by]
    merged = sets.groupBy(*named, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    keys = [c for c in merged.columns if c not in ("bucket", "bitmap")]
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def daily_sketches(df: DataFrame, day: Column, value: Column, by: list[str] | None = None, k: int = K) -> DataFrame:
    """date, by and a mergeable quantile sketch of a day's values; nulls are left out."""
    rows = df.select(day.alias("date"), *(by or []), value.cast("double").alias("x")).filter("x IS NOT NULL")
    return rows.groupBy("date", *(by or [])).agg(F.kll_sketch_agg_double("x", k).alias("sketch"))


def percentiles(sketches: DataFrame, shares: dict[str, float], *by: Column | str, k: int = K) -> DataFrame:
    """by, n and the percentiles, within the sketch's rank error, of stored daily sketches."""
    named = [F.col(c) if isinstance(c, str) else c for c in by]
    merged = sketches.groupBy(*named).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    keys = [c for c in merged.columns if c != "sketch"]
    return merged.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in shares.items()])


def rank_error(df: DataFrame, estimates: DataFrame, period: Column, value: Column, shares: dict[str, float]) -> DataFrame:
    """period, and for each percentile how far its rank among the raw values (a range, where they repeat) is from its share."""
    rows = df.select(period.alias("period"), value.cast("double").alias("x")).filter("x IS NOT NULL")
    both = rows.join(F.broadcast(estimates.select("period", *shares)), "period")
    below, upto = ({name: F.avg(f(F.col("x"), F.col(name)).cast("double")) for name in shares} for f in (lambda a, b: a < b, lambda a, b: a <= b))
    return both.groupBy("period").agg(*[F.greatest(below[n] - q, F.lit(q) - upto[n], F.lit(0.0)).alias(n) for n, q in shares.items()])

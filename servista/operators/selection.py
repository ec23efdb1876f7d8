"""Exact order statistics of groups of any size: radix selection over the ordered bits of a double.

A value's bits, read from the most significant digit, sort as the value does. Each pass counts the next digit of the values that
share the digits known so far of a sought rank, and the digit in which the rank falls becomes known. Counts are summed before
the shuffle, so a group is never gathered: a task gets at most 2**DIGIT counts of each rank's digit, however many rows there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from servista.plans.session import scratch

#: Bits that one pass tells apart; it divides 64.
DIGIT = 16
#: Values of the largest group up to which a group may be held by one task: then Spark's own exact percentile gives the same.
HELD = 1_000_000
_TOP = -(2**63)


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A number that sorts, as unsigned, as the double does; 0.0 and -0.0 are one, and NaN comes last."""
    v = np.where(np.isnan(x.to_numpy(np.float64)), np.nan, x.to_numpy(np.float64) + 0.0)
    bits = v.view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(2**63 - 1)) ^ np.int64(_TOP))


def value_of_bits(bits: Column | str) -> Column:
    return F.coalesce(_value(bits), F.lit(float("nan")))  # pandas takes NaN for a null


@F.pandas_udf(T.DoubleType())
def _value(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(np.int64) ^ np.int64(_TOP)
    return pd.Series((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def select(values: DataFrame, targets: DataFrame, work: str) -> DataFrame:
    """targets (g, rank, ...) with the value of each rank (from 0) among the values (g, bits) of its group g, as `value`.

    values is a written table; `work` is a folder for the passes' tables, a row for each target.
    """
    found = targets.select("*", F.lit(0).cast("long").alias("prefix"), F.col("rank").alias("left"))
    for k in range(64 // DIGIT):
        low = 64 - DIGIT * (k + 1)
        digit = F.shiftrightunsigned("bits", low).bitwiseAND(F.lit(2**DIGIT - 1))
        known = F.shiftrightunsigned("bits", low + DIGIT) if k else F.lit(0).cast("long")
        rows = values.select("g", known.alias("prefix"), digit.alias("digit"))
        if k:
            rows = rows.join(found.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        counts = rows.groupBy("g", "prefix", "digit").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("digit"))
        counts = counts.withColumn("upto", upto)
        hit = (F.col("left") >= F.col("upto") - F.col("n")) & (F.col("left") < F.col("upto"))
        found = found.join(counts, ["g", "prefix"]).filter(hit)
        found = found.select(*targets.columns, (F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit"))).alias("prefix"), (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"))
        found = _kept(found, f"{work}/pass={k}")
    return found.select(*targets.columns, value_of_bits("prefix").alias("value"))


def quantiles(df: DataFrame, column: str, shares: dict[str, float], by: list[str] | None = None, held: int | None = None) -> DataFrame:
    """Exact quantiles of a column by group, linear between neighbours, under the names of `shares`; n and mean of its values.

    Nulls are left out; a group without values has n = 0 and nulls. Where no group has more than `held` values (HELD) a task
    holds a group's; else the rows are read once more, into a table of group and bits, and ranks are selected.
    """
    by, work = list(by or []), scratch(df.sparkSession, "quantiles")
    x, group = F.col(column).cast("double"), F.struct(*[F.col(c) for c in by] or [F.lit(0).alias("all")])
    # an aggregate of its own reads the groups' sizes; without groups there is one row even of an empty table
    sizes = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean")).select(group.alias("g"), "n", "mean")
    sizes = _kept(sizes, f"{work}/sizes")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= (HELD if held is None else held):
        return df.groupBy(*by).agg(*[F.percentile(x, float(q)).alias(name) for name, q in shares.items()], F.count(x).alias("n"), F.avg(x).alias("mean"))
    values = _kept(df.filter(x.isNotNull()).select(group.alias("g"), ordered_bits(x).alias("bits")), f"{work}/bits")
    places = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("place")) for name, q in shares.items()])
    sought = sizes.filter("n > 0").select("g", F.explode(places).alias("p")).select("g", "p.name", "p.place")
    targets = sought.select("g", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    found = select(values, targets, work)
    below, above = (found.select("g", F.col("rank").alias(f"{side}_rank"), F.col("value").alias(side)) for side in ("below", "above"))
    both = sought.withColumns({"below_rank": F.floor("place"), "above_rank": F.ceil("place")}).join(below, ["g", "below_rank"]).join(above, ["g", "above_rank"])
    value = F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(F.col("below") + (F.col("above") - F.col("below")) * (F.col("place") - F.col("below_rank")))
    wide = both.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in shares])
    out = sizes.join(wide, "g", "left")
    return out.select(*[F.col("g").getField(c).alias(c) for c in by], *shares, "n", "mean")

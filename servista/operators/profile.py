"""Exploratory aggregates. None collects rows; each is one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from servista.operators import frequent, selection


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """value, n, pct of all rows (nulls are a value); the most frequent first, ties by value.

    The total is an aggregate of its own. With `top` only values that may be among the first are counted (see frequent).
    """
    values = df.select(F.col(column).cast("string").alias("value"))
    out = values.groupBy("value").agg(F.count("*").alias("n")) if top is None else frequent.top_values(values, top)
    total = df.agg(F.count("*").alias("total"))
    out = out.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))
    return out.orderBy(F.desc("n"), F.asc_nulls_first("value"))


def null_profile(df: DataFrame) -> DataFrame:
    """One row a column: rows, non-null, distinct values, the least one as a sample, null_rate, and the tolerance it suggests.

    Two scans, whatever the number of columns: one for counts and least values, one for the distinct values of all columns, which go
    through one shuffle as (column, value) after equal ones of a task have become one.
    """
    kinds = dict(df.dtypes)
    each = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]

    def text(c: Column, kind: str) -> Column:
        if kind in ("double", "float"):
            return (c + F.lit(0.0)).cast("string")  # -0.0 is 0.0
        return F.hex(c) if kind == "binary" else F.to_json(F.struct(c.alias("x"))) if "<" in kind else c.cast("string")

    wide = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n{k}") for k, c in enumerate(each)], *[F.min(c).cast("string").alias(f"least{k}") for k, c in enumerate(each)])
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.when(c.isNotNull(), text(c, kinds[name])).alias("x")) for k, (name, c) in enumerate(zip(df.columns, each, strict=True))])
    distinct = df.select(F.explode(values).alias("v")).select("v.k", "v.x").filter("x IS NOT NULL").distinct().groupBy("k").agg(F.count("*").alias("n_distinct"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("column"), F.col("n_rows"), F.col(f"n{k}").alias("n_values"), F.col(f"least{k}").alias("sample")) for k, name in enumerate(df.columns)])
    out = wide.select(F.explode(rows).alias("r")).select("r.*").join(F.broadcast(distinct), "k", "left")  # a row a column
    rate = 1 - F.try_divide(F.col("n_values"), F.col("n_rows"))
    out = out.select("column", "n_rows", "n_values", F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"), "sample", F.coalesce(rate, F.lit(0.0)).alias("null_rate"))
    return out.withColumn("recommendation", recommendation(F.col("null_rate")))


def recommendation(rate: Column) -> Column:
    # Null-rate bands.
    return F.when(rate < 0.01, "critical").when(rate < 0.05, "required").when(rate < 0.10, "mostly").when(rate < 0.15, "optional").otherwise("nullable")


def quantiles(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Exact quartiles, 95th percentile and mean; large groups by radix selection, so that no task holds one (see selection)."""
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return selection.quantiles(df, column, shares, by).drop("n")


def median_of_smallest(df: DataFrame, column: str, group: str, k: int = 10) -> DataFrame:
    """n and the exact median of a column in the k groups that sort first."""
    first = df.select(group).filter(F.col(group).isNotNull()).distinct().orderBy(group).limit(k)
    return df.join(F.broadcast(first), group, "left_semi").groupBy(group).agg(F.count("*").alias("n"), F.median(column).alias("median"))


def breakdown(df: DataFrame, group: str, value: object, top: int = 10, column: str = "sr_type") -> DataFrame:
    """Of the rows of one group: the most frequent values of a column, with the share of completed ones."""
    done = F.avg(F.when(F.col("status") == "COMPLETED", 1.0).otherwise(0.0))
    return df.filter(F.col(group) == value).groupBy(column).agg(F.count("*").alias("n"), done.alias("completed_share")).orderBy(F.desc("n"), column).limit(top)


def insights(df: DataFrame, instant: float = 0.1, one_day: float = 24.0) -> DataFrame:
    """One row: closed requests, those closed at once and within a day, information calls, and requests without a ward."""
    hours = F.col("resolution_hours")
    return df.agg(F.count(hours).alias("closed"), F.count_if(hours <= instant).alias("instant"), F.count_if(hours < one_day).alias("within_a_day"), F.count_if("is_info_call").alias("info_calls"), F.count_if(F.col("ward").isNull()).alias("without_ward"))


def with_daily(days: DataFrame, other: DataFrame, date: str = "date", other_date: str = "date") -> DataFrame:
    """Daily rows joined with another daily table, such as the weather's; days it lacks have nulls."""
    other = other.withColumnRenamed(other_date, "__date")
    return days.join(other, F.col(date) == F.col("__date"), "left").drop("__date")


def daily_stats(df: DataFrame, column: str = "created_date", sigmas: float = 2.0) -> DataFrame:
    """Of the daily counts: mean, sample standard deviation, least, most, variation and the anomaly threshold."""
    n = df.groupBy(F.to_date(column).alias("date")).agg(F.count("*").alias("n"))
    out = n.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("least"), F.max("n").alias("most"))
    return out.select("*", F.try_divide("std", "mean").alias("variation"), (F.col("mean") + sigmas * F.col("std")).alias("threshold"))


def weekend_drop(df: DataFrame, column: str = "created_date") -> DataFrame:
    """Mean daily counts of weekdays and weekends, the drop in percent and the weekend factor."""
    n = df.groupBy(F.to_date(column).alias("date")).agg(F.count("*").alias("n"))
    weekend = F.dayofweek("date").isin(1, 7)
    out = n.agg(F.avg(F.when(~weekend, F.col("n"))).alias("weekday_mean"), F.avg(F.when(weekend, F.col("n"))).alias("weekend_mean"))
    return out.select("*", ((1 - F.try_divide("weekend_mean", "weekday_mean")) * 100).alias("drop_pct"), F.try_divide("weekend_mean", "weekday_mean").alias("weekend_factor"))


def by_weekday(df: DataFrame, column: str = "created_date") -> DataFrame:
    """Counts by day name; Monday is 0."""
    c = F.col(column)
    return df.groupBy(F.weekday(c).alias("day_number"), F.date_format(c, "EEEE").alias("day_name")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """bin (0 to bins-1), its lower edge and the count of values from low to high, both included."""
    c, width = F.col(column), (high - low) / bins
    at = F.least(F.floor((c - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.filter(c.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("edge"), "n")


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    total, unique = F.count("*"), F.countDistinct(key)
    return df.agg(total.alias("total"), unique.alias("unique"), (F.try_divide(total - unique, total) * 100).alias("duplicate_pct"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def coordinates(df: DataFrame, latitude: tuple[float, float], longitude: tuple[float, float]) -> DataFrame:
    """Least, greatest and mean coordinates, and the share of rows with both inside the box."""
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    inside = lat.between(*latitude) & lon.between(*longitude)
    named = [(f(c).alias(f"{n}_{k}")) for k, c in (("latitude", lat), ("longitude", lon)) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.agg(*named, F.try_divide(F.count_if(both & inside), F.count_if(both)).alias("inside_share"))


def ward_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("ward").agg(F.count("sr_number").alias("requests"), F.avg(F.when(F.col("status") == "COMPLETED", 1.0).otherwise(0.0)).alias("completed_share"))


def ward_summary_with_resolution(df: DataFrame) -> DataFrame:
    """ward_summary joined with each ward's mean resolution hours."""
    mean = df.groupBy("ward").agg(F.avg("resolution_hours").alias("mean_resolution_hours"))
    return ward_summary(df).join(mean, "ward", "left")


def top_groups_daily(df: DataFrame, group: str, k: int, column: str = "created_date") -> DataFrame:
    """Daily counts of the k largest groups (ties by group): a semi join with a top-k."""
    top = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(k)
    return df.join(F.broadcast(top), group, "left_semi").groupBy(F.to_date(column).alias("date"), group).agg(F.count("*").alias("n"))


def only_in(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Values of a column that occur where the condition holds and nowhere else."""
    return df.filter(condition).select(column).subtract(df.filter(~condition).select(column))


def metrics(df: DataFrame) -> DataFrame:
    """Key figures as (metric, value) pairs of strings."""
    figures = {
        "total_requests": F.count("*"),
        "unique_requests": F.countDistinct("sr_number"),
        "first_day": F.min(F.to_date("created_date")),
        "last_day": F.max(F.to_date("created_date")),
        "request_types": F.countDistinct("sr_type"),
        "wards": F.countDistinct("ward"),
        "departments": F.countDistinct("owner_department"),
        "completed": F.count_if(F.col("status") == "COMPLETED"),
        "open": F.count_if(F.col("status") == "OPEN"),
        "info_calls": F.count_if("is_info_call"),
        "info_call_pct": F.round(F.avg(F.col("is_info_call").cast("int")) * 100, 2),
    }
    wide = df.agg(*[x.cast("string").alias(k) for k, x in figures.items()])
    return wide.unpivot([], list(figures), "metric", "value")


def anomalies(daily: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows with the threshold mean + sigmas standard deviations, whether they exceed it, and by how much of it."""
    limit = daily.agg((F.avg(value) + sigmas * F.stddev_samp(value)).alias("threshold"))
    c = F.col(value)
    return daily.crossJoin(F.broadcast(limit)).select("*", F.coalesce(c > F.col("threshold"), F.lit(False)).alias("is_anomaly"), F.when(c > F.col("threshold"), (c - F.col("threshold")) / F.col("threshold")).alias("anomaly_score"))

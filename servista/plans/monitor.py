"""Health views over history and current requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servista.functions.dates import hours_between
from servista.operators.history import END, START

# Healthy bands.
VERSION_RATE, INFO_RATIO = (1.0, 2.0), (0.35, 0.45)


def _band(value: Column, low: float, high: float, good: str) -> Column:
    return F.when(value.between(low, high), good).otherwise("INVESTIGATE")


def version_stats(history: DataFrame, key: str = "sr_number") -> DataFrame:
    out = history.agg(
        F.countDistinct(key).alias("total_unique_requests"),
        F.count("*").alias("total_versions"),
        F.count_if(F.col(END).isNull()).alias("current_versions"),
        F.count_if(F.col(END).isNotNull()).alias("historical_versions"),
        F.max(START).alias("latest_version_start"),
    )
    rate = F.round(F.try_divide(F.col("total_versions"), F.col("total_unique_requests")), 2)
    return out.withColumn("avg_versions_per_request", rate).withColumn("version_rate_status", _band(rate, *VERSION_RATE, "HEALTHY"))


def freshness(layers: dict[str, tuple[DataFrame, str]], now: Column) -> DataFrame:
    """One row a layer: its latest time, number of rows and hours since then. layers: name -> (rows, time column)."""
    out = None
    for name, (df, column) in layers.items():
        one = df.agg(F.max(column).alias("latest_record"), F.count("*").alias("total_records")).select(F.lit(name).alias("layer"), "latest_record", "total_records", hours_between(F.col("latest_record"), now).alias("hours_since_update"))
        out = one if out is None else out.unionByName(one)
    return out


def info_call_ratio(requests: DataFrame, days: int = 30) -> DataFrame:
    """The latest days' share of information calls."""
    out = requests.groupBy(F.to_date("created_date").alias("date")).agg(F.count("*").alias("total_requests"), F.count_if("is_info_call").alias("info_calls"))
    share = F.col("info_calls") / F.col("total_requests")
    return out.select("*", F.round(share * 100, 1).alias("info_call_pct"), _band(share, *INFO_RATIO, "NORMAL").alias("ratio_status")).orderBy(F.desc("date")).limit(days)


def status_distribution(requests: DataFrame) -> DataFrame:
    out = requests.groupBy("status").agg(F.count("*").alias("count"))
    return out.withColumn("pct", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()), 1)).orderBy(F.desc("count"))


def bands(value: Column, warning: tuple[float, float], critical: tuple[float, float]) -> Column:
    """OK inside the warning range, WARNING inside the critical range, else CRITICAL."""
    return F.when(value.between(*warning), "OK").when(value.between(*critical), "WARNING").otherwise("CRITICAL")


def freshness_band(hours: Column, warning: int = 24, critical: int = 48) -> Column:
    return F.when(hours > critical, "CRITICAL").when(hours > warning, "WARNING").otherwise("OK")

"""Daily aggregates of current requests. Each is one shuffle by its group keys; windows run on the aggregated days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servista.functions.dates import calendar

#: percentile_approx is exact up to half as many values a group, and off by one in so many ranks beyond; its memory is bounded by that.
ACCURACY = 10_000
#: Row frames of the rolling averages, as the source has them: 8 and 29 rows, the present one excluded.
WEEK, MONTH = (-8, -1), (-29, -1)
# Mean plus two standard deviations of daily counts.
ANOMALY_SERVICE, ANOMALY_TOTAL = 4851, 7580


def _day() -> Column:
    return F.to_date("created_date").alias("date")


def _is(status: str) -> Column:
    return F.col("status") == status


def _share(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("double") / F.count("*")


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def daily_aggregates(requests: DataFrame) -> DataFrame:
    return (
        requests.groupBy(_day(), "ward", "sr_type", "is_info_call")
        .agg(
            F.count("*").alias("total_requests"),
            *[_count(_is(s)).alias(f"{s.lower()}_count") for s in ("COMPLETED", "OPEN", "CANCELED")],
            F.avg("resolution_hours").alias("avg_resolution_hours"),
            F.percentile_approx("resolution_hours", 0.5, ACCURACY).alias("median_resolution_hours"),
            _share(_is("COMPLETED")).alias("completion_rate"),
            *[_count(F.col("origin") == o).alias(f"{o.lower()}_requests") for o in ("PHONE", "WEB", "APP")],
        )
        .select("*", *calendar(F.col("date")))
    )


def _volumes() -> list[Column]:
    return [F.count("*").alias("total_requests"), _count(~F.col("is_info_call")).alias("service_requests"), _count(F.col("is_info_call")).alias("info_calls"), F.countDistinct("sr_type").alias("unique_sr_types")]


def _lags(column: str, over, days: dict[str, int]) -> list[Column]:
    return [F.lag(column, n).over(over).alias(f"requests_{name}_ago") for name, n in days.items()]


def _rolling(column: str, over, frames: tuple = (WEEK, MONTH)) -> list[Column]:
    return [F.avg(column).over(over.rowsBetween(*f)).alias(name) for f, name in zip(frames, ("rolling_7d_avg", "rolling_28d_avg"), strict=True)]


def ward_daily_summary(requests: DataFrame, frames: tuple = (WEEK, MONTH)) -> DataFrame:
    """Daily volumes by ward with lags and rolling averages over rows; days without requests are no rows."""
    days = requests.groupBy(_day(), "ward").agg(*_volumes(), F.avg("resolution_hours").alias("avg_resolution_hours"), _share(_is("COMPLETED")).alias("completion_rate"))
    over = Window.partitionBy("ward").orderBy("date")
    return days.select("*", *_lags("total_requests", over, {"1d": 1, "7d": 7, "28d": 28}), *_rolling("total_requests", over, frames), *calendar(F.col("date")))


def densified(days: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """days with a row for every key and calendar day between the first and the last one; absent counts are 0.

    For windows over calendar days instead of rows. Bounded by keys times days.
    """
    span = days.groupBy(key).agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return span.join(days, [key, "date"], "left").fillna(0, fill)


def citywide_daily_summary(requests: DataFrame, frames: tuple = (WEEK, MONTH), service_limit: int = ANOMALY_SERVICE, total_limit: int = ANOMALY_TOTAL) -> DataFrame:
    """One row a day. Its windows have no partition, over as many rows as there are days."""
    hours = F.col("resolution_hours")
    days = requests.groupBy(_day()).agg(
        *_volumes(),
        F.countDistinct("ward").alias("wards_with_requests"),
        F.avg(hours).alias("avg_resolution_hours"),
        F.avg(F.when(hours > 0.1, hours)).alias("avg_resolution_hours_excl_instant"),
        _share(_is("COMPLETED")).alias("completion_rate"),
    )
    over = Window.orderBy("date")
    year = F.col("requests_1y_ago")
    return (
        days.select("*", *_lags("service_requests", over, {"1d": 1, "7d": 7, "28d": 28, "1y": 365}), *_rolling("service_requests", over, frames))
        .select(
            F.col("date").alias("ds"),
            F.col("service_requests").alias("y"),
            "*",
            F.when(year > 0, (F.col("service_requests") - year).cast("double") / year).alias("yoy_change"),
            *calendar(F.col("date"), full=True),
            (F.col("service_requests") > service_limit).alias("is_anomaly_service"),
            (F.col("total_requests") > total_limit).alias("is_anomaly_total"),
        )
    )


def department_performance(requests: DataFrame) -> DataFrame:
    hours = F.col("resolution_hours")
    return requests.groupBy("owner_department", _day()).agg(
        F.count("*").alias("total_requests"),
        _count(~F.col("is_info_call")).alias("service_requests"),
        F.countDistinct("sr_type").alias("sr_types_handled"),
        _count(_is("COMPLETED")).alias("completed_count"),
        _share(_is("COMPLETED")).alias("completion_rate"),
        F.avg(hours).alias("avg_resolution_hours"),
        F.percentile_approx(hours, 0.5, ACCURACY).alias("median_resolution_hours"),
        F.percentile_approx(hours, 0.9, ACCURACY).alias("p90_resolution_hours"),
    )


def request_type_summary(requests: DataFrame) -> DataFrame:
    """By day and type; the most common ward is the smallest one on ties."""
    return requests.groupBy(_day(), "sr_type", "is_info_call").agg(
        F.count("*").alias("total_requests"),
        _count(_is("COMPLETED")).alias("completed_count"),
        _share(_is("COMPLETED")).alias("completion_rate"),
        F.avg("resolution_hours").alias("avg_resolution_hours"),
        F.expr("mode() WITHIN GROUP (ORDER BY ward)").alias("most_common_ward"),
        F.countDistinct("ward").alias("wards_affected"),
    )


def write_gold(df: DataFrame, path: str, sort_by: list[str], rows_per_file: int = 2_000_000) -> None:
    """Partitioned by date, sorted within files by the keys that readers filter on.

    Rows of a date come together; adaptive execution splits a date that is too large for one writer and merges small ones.
    """
    df.hint("rebalance", "date").sortWithinPartitions("date", *sort_by).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("date").parquet(path)

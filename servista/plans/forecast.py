"""Forecast baseline and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def seasonal_naive(daily: DataFrame, season: int = 7, band: float = 2.0) -> DataFrame:
    """daily (ds, y) with yhat, the value a season of rows ago, and bounds of so many standard deviations of the error.

    The window has no partition; it runs over one row a day.
    """
    out = daily.withColumn("yhat", F.lag("y", season).over(Window.orderBy("ds"))).filter("yhat IS NOT NULL")
    width = F.coalesce(F.stddev_samp(F.col("y") - F.col("yhat")).over(Window.partitionBy()), F.lit(0.0)) * band
    return out.select("ds", "y", "yhat", (F.col("yhat") - width).alias("yhat_lower"), (F.col("yhat") + width).alias("yhat_upper"))


def accuracy(forecast: DataFrame) -> DataFrame:
    """n, MAPE in percent (days without requests left out), RMSE and the share of values inside the bounds."""
    error = F.col("y") - F.col("yhat")
    return forecast.agg(
        F.count("*").alias("n"),
        (F.avg(F.when(F.col("y") != 0, F.abs(error) / F.col("y"))) * 100).alias("mape"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double")).alias("coverage"),
    )


def forecast_anomalies(forecast: DataFrame) -> DataFrame:
    """Days above the upper bound, with the excess as a share of it."""
    over = F.col("y") > F.col("yhat_upper")
    return forecast.select("*", over.alias("is_anomaly"), F.when(over, (F.col("y") - F.col("yhat_upper")) / F.col("yhat_upper")).alias("anomaly_score"))


def precision_recall(flags: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    both = F.count_if(F.col(predicted) & F.col(actual))
    return flags.agg(F.try_divide(both, F.count_if(predicted)).alias("precision"), F.try_divide(both, F.count_if(actual)).alias("recall"))

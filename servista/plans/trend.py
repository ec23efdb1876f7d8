"""Forecast of many series at once: piecewise-linear trend and Fourier terms, fitted by normal equations.

The sums of products of all terms are one aggregate by series, combined before its shuffle; a series then is one row of sums, whose
ridge solution is its fit. No series is gathered, however long it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Seasons as (days, pairs of sine and cosine).
SEASONS = ((7.0, 2), (365.25, 2))


@dataclass(frozen=True)
class Design:
    """Terms of the fit: 1, t, a bend at each knot, and the seasons. t runs from 0 to 1 between first and last."""

    first: date
    last: date
    knots: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)
    seasons: tuple[tuple[float, int], ...] = field(default=SEASONS)

    def names(self) -> list[str]:
        return ["level", "slope", *[f"bend_{k:g}" for k in self.knots], *[f"{part}_{days:g}_{k}" for days, n in self.seasons for k in range(1, n + 1) for part in ("sin", "cos")]]

    def terms(self, ds: Column) -> list[Column]:
        day = F.date_diff(ds, F.lit(self.first)).cast("double")
        t = day / max((self.last - self.first).days, 1)
        angle = lambda days, k: day * (2 * math.pi * k / days)
        waves = [f(angle(days, k)) for days, n in self.seasons for k in range(1, n + 1) for f in (F.sin, F.cos)]
        return [F.lit(1.0), t, *[F.greatest(t - k, F.lit(0.0)) for k in self.knots], *waves]


def design(daily: DataFrame, **options) -> Design:
    """The design between the first and last day of daily."""
    span = daily.agg(F.min("ds").alias("first"), F.max("ds").alias("last")).first()
    return Design(span["first"] or date(1970, 1, 1), span["last"] or date(1970, 1, 1), **options)


def sums(daily: DataFrame, by: list[str], terms: Design) -> DataFrame:
    """by, n, and the sums of products of terms and y, as a row-wise upper triangle with y as the last term."""
    p = len(terms.names())
    x = [f"x{i}" for i in range(p + 1)]
    rows = daily.filter(F.col("y").isNotNull() & F.col("ds").isNotNull()).select(*by, *[c.alias(n) for c, n in zip([*terms.terms(F.col("ds")), F.col("y").cast("double")], x, strict=True)])
    products = [F.sum(F.col(x[i]) * F.col(x[j])) for i in range(p + 1) for j in range(i, p + 1)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*products).alias("sums"))


def _solver(p: int, ridge: float):
    """A function of columns of sums and n: coefficients, and last the standard deviation of what they leave."""
    upper = np.triu_indices(p + 1)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for each, n in parts:
            out = []
            for own, count in zip(each, n, strict=True):
                a = np.zeros((p + 1, p + 1))
                a[upper] = own
                a = np.triu(a) + np.triu(a, 1).T
                b = np.linalg.solve(a[:p, :p] + ridge * np.eye(p), a[:p, p])
                left = a[p, p] - 2 * b @ a[:p, p] + b @ a[:p, :p] @ b
                out.append([*b, math.sqrt(max(left, 0.0) / max(count - p, 1))])
            yield pd.Series(out)

    return solve


def fit(daily: DataFrame, by: list[str], terms: Design | None = None, ridge: float = 1.0) -> DataFrame:
    """by, n, coefficients (in the order of terms.names()) and sigma of each series of daily (by, ds, y).

    Each diagonal element gets `ridge` added, so that a series of few days has a solution too.
    """
    terms = terms or design(daily)
    p = len(terms.names())
    made = sums(daily, by, terms).withColumn("b", _solver(p, ridge)("sums", "n"))
    return made.select(*by, "n", F.slice("b", 1, p).alias("coefficients"), F.element_at("b", -1).alias("sigma"))


def predict(days: DataFrame, fitted: DataFrame, by: list[str], terms: Design, band: float = 2.0) -> DataFrame:
    """days (by, ds, ...) with yhat and its bounds, so many standard deviations away; days of unknown series go."""
    yhat = sum((F.element_at("coefficients", i + 1) * x for i, x in enumerate(terms.terms(F.col("ds")))), F.lit(0.0))
    out = days.join(fitted.select(*by, "coefficients", "sigma"), by).withColumn("yhat", yhat)
    return out.withColumns({"yhat_lower": F.col("yhat") - band * F.col("sigma"), "yhat_upper": F.col("yhat") + band * F.col("sigma")}).drop("coefficients", "sigma")


def future(fitted: DataFrame, by: list[str], terms: Design, periods: int = 30, band: float = 2.0) -> DataFrame:
    """by, ds, yhat and its bounds of the days after the last one."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
    days = fitted.select(*by, ahead).select(*by, F.date_add(F.lit(terms.last), F.col("step")).alias("ds"))
    return predict(days, fitted, by, terms, band)


def held_out(daily: DataFrame, by: list[str], days: int = 28, season: int = 7) -> DataFrame:
    """by, n and MAPE in percent of the last `days` days, by the fit to the days before and by the value some whole seasons ago.

    Days without either are left out of both, as are days with y = 0. Series are joined by day, not windowed.
    """
    whole = design(daily)
    cut = F.date_sub(F.lit(whole.last), days)
    before = daily.filter(F.col("ds") <= cut)
    terms = design(before)
    test = predict(daily.filter((F.col("ds") > cut) & (F.col("y") != 0)), fit(before, by, terms), by, terms)
    weeks = F.ceil(F.date_diff("ds", cut) / season) * season
    ago = before.select(*by, F.col("ds").alias("ago"), F.col("y").alias("naive"))
    both = test.withColumn("ago", F.date_sub("ds", weeks.cast("int"))).join(ago, [*by, "ago"])
    mape = lambda c: F.avg(F.abs(F.col("y") - F.col(c)) / F.col("y")) * 100
    return both.groupBy(*by).agg(F.count("*").alias("n"), mape("yhat").alias("mape"), mape("naive").alias("naive_mape"))

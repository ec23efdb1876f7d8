"""Queries over daily series: forecasts of all wards at once, and gold tables whose days add up to longer periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from servista.operators import rollup
from servista.plans import trend
from servista.plans.adapter import REQUESTS_SQL as R, requests, table
from servista.plans.registry import query
from servista.plans.session import scratch


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).groupBy("ward", F.to_date("created_date").alias("ds")).agg(F.count("*").alias("y"))


#: The terms of a day in SQL, as list x; d is the number of days since `first`, t their share of the span.
_X = "[1.0, t, greatest(t - 0.2, 0), greatest(t - 0.4, 0), greatest(t - 0.6, 0), greatest(t - 0.8, 0)" + "".join(f", {f}(d * 2 * pi() * {k} / {days})" for days in ("7.0", "365.25") for k in (1, 2) for f in ("sin", "cos")) + "]"


def _fit_sql(until: str) -> str:
    """Coefficients b by ward, of days up to `until`: the normal equations with 1 added to their diagonal, eliminated row by row."""
    return f"""days AS (SELECT ward, date AS ds, CAST(count(*) AS DOUBLE) AS y FROM r GROUP BY ward, date), train AS (SELECT * FROM days WHERE ds <= {until}),
 span AS (SELECT min(ds) AS first, max(ds) AS last FROM train),
 terms AS (SELECT ward, ds, y, {_X} AS x FROM (SELECT ward, ds, y, CAST(ds - first AS DOUBLE) AS d, CAST(ds - first AS DOUBLE) / greatest(last - first, 1) AS t FROM days, span)),
 sums AS (SELECT ward, i, j, sum(x[i] * list_append(x, y)[j]) + CAST(i = j AS INTEGER) AS v FROM terms, generate_series(1, 14) AS a(i), generate_series(1, 15) AS b(j) WHERE ds <= {until} GROUP BY ward, i, j),
 m AS (SELECT ward, list(own ORDER BY i) AS m FROM (SELECT ward, i, list(v ORDER BY j) AS own FROM sums GROUP BY ward, i) GROUP BY ward),
 g AS (SELECT ward, 1 AS k, m FROM m UNION ALL SELECT ward, k + 1, list_transform(m, lambda own, i: CASE WHEN i = k THEN list_transform(own, lambda v: v / m[k][k]) ELSE list_transform(own, lambda v, j: v - own[k] * m[k][j] / m[k][k]) END) FROM g WHERE k <= 14),
 b AS (SELECT ward, list_transform(m, lambda own: own[15]) AS b FROM g WHERE k = 15)"""


_ALL, _CUT = "(SELECT max(ds) FROM days)", "(SELECT max(ds) - 28 FROM days)"


@query(f"WITH RECURSIVE {R}, {_fit_sql(_ALL)} SELECT ward, CAST(i AS INTEGER) AS term, round(b[i], 4) + 0.0 AS coefficient FROM b, generate_series(1, 14) AS a(i)")
def forecast_coefficients(spark, sf_dir):
    """The fit of every ward's daily requests, in one job."""
    fitted = trend.fit(_daily(spark, sf_dir), ["ward"])
    return fitted.select("ward", F.posexplode("coefficients").alias("term", "coefficient")).select("ward", (F.col("term") + 1).alias("term"), (F.round("coefficient", 4) + F.lit(0.0)).alias("coefficient"))


@query(f"""WITH RECURSIVE {R}, {_fit_sql(_CUT)}, test AS (SELECT t.ward, t.ds, t.y, list_dot_product(x, b) AS yhat, a.y AS naive FROM terms t JOIN b ON b.ward = t.ward JOIN train a ON a.ward = t.ward AND a.ds = t.ds - 7 * CAST(ceil((t.ds - {_CUT}) / 7) AS INTEGER) WHERE t.ds > {_CUT})
 SELECT ward, count(*) AS n, round(avg(abs(y - yhat) / y) * 100, 4) AS mape, round(avg(abs(y - naive) / y) * 100, 4) AS naive_mape FROM test GROUP BY ward""")
def forecast_held_out(spark, sf_dir):
    """Errors of the last 28 days, fitted to the days before, beside the seasonal-naive ones."""
    return trend.held_out(_daily(spark, sf_dir), ["ward"]).withColumns({c: F.round(c, 4) for c in ("mape", "naive_mape")})


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL UNION ALL SELECT strftime(o_orderdate, '%Y'), NULL, count(DISTINCT o_custkey) FROM orders GROUP BY 1")
def distinct_customers_from_days(spark, sf_dir):
    """Exact distinct customers of months by priority and of years, from one stored table of days."""
    days = _stored(rollup.daily_sets(table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), F.col("o_custkey"), ["o_orderpriority"]), "daily-sets")
    months = rollup.distinct_ids(days, F.date_format("date", "yyyy-MM").alias("period"), "o_orderpriority")
    years = rollup.distinct_ids(days, F.date_format("date", "yyyy").alias("period")).select("period", F.lit(None).cast("string").alias("o_orderpriority"), "n")
    return months.unionByName(years)


#: Rank error that the merged sketches stay below.
_WITHIN = 0.01


@query("SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n, true AS p50, true AS p95 FROM orders GROUP BY 1")
def percentiles_from_days(spark, sf_dir):
    """Whether the percentiles of years, from stored sketches of days, are within the stated rank error of the raw rows."""
    orders, shares = table(spark, sf_dir, "orders"), {"p50": 0.5, "p95": 0.95}
    days = _stored(rollup.daily_sketches(orders, F.to_date("o_orderdate"), F.col("o_totalprice")), "daily-sketches")
    year = lambda c: F.date_format(c, "yyyy")
    estimates = _stored(rollup.percentiles(days, shares, year("date").alias("period")), "percentiles")
    errors = rollup.rank_error(orders, estimates, year("o_orderdate"), F.col("o_totalprice"), shares)
    return errors.join(estimates.select("period", "n"), "period").select("period", "n", *[(F.col(c) <= _WITHIN).alias(c) for c in shares])

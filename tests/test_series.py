"""Forecasts against a plain least-squares fit, and rollups against raw rows."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from servista.operators import rollup
from servista.plans import trend

DAY0 = dt.date(2020, 1, 1)


def series(n, seed):
    rng = random.Random(seed)
    rows = []
    for w, (level, slope, wave) in {"a": (50, 0.01, 5), "b": (200, -0.05, 40), None: (9, 0, 2)}.items():
        rows += [(w, DAY0 + dt.timedelta(days=i), float(round(level + slope * i + wave * math.sin(2 * math.pi * i / 7) + 8 * math.cos(2 * math.pi * i / 365.25) + rng.gauss(0, 1), 3))) for i in range(n) if rng.random() < 0.95]
    return [*rows, ("a", None, 1.0), ("b", DAY0, None), ("short", DAY0, 3.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "w string, ds date, y double")


def test_coefficients_equal_least_squares_of_duckdb_sums(spark):
    rows = series(900, 1)
    df = frame(spark, rows)
    terms = trend.design(df)
    got = {r.w: r for r in trend.fit(df, ["w"], terms).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (w VARCHAR, d DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(w, (ds - terms.first).days, y) for w, ds, y in rows if ds and y is not None])
    span = (terms.last - terms.first).days
    x = ["1.0", f"d / {span}", *[f"greatest(d / {span} - {k}, 0)" for k in terms.knots], *[f"{f}(2 * pi() * {k} * d / {days})" for days, n in terms.seasons for k in range(1, n + 1) for f in ("sin", "cos")]]
    p = len(x)
    assert p == len(terms.names())
    for w in got:
        own = con.execute("SELECT " + ", ".join(f"sum({a} * {b})" for a in x for b in [*x, "y"]) + " FROM t WHERE w IS NOT DISTINCT FROM ?", [w]).fetchone()
        a = np.array(own, float).reshape(p, p + 1)
        want = np.linalg.solve(a[:, :p] + np.eye(p), a[:, p])
        assert np.allclose(got[w].coefficients, want, rtol=0, atol=1e-6)
    assert got["short"].n == 1 and got["a"].n > 800
    assert "SinglePartition" not in trend.fit(df, ["w"], terms)._jdf.queryExecution().executedPlan().toString()


def test_forecast_follows_the_series(spark):
    df = frame(spark, series(800, 2)).filter("w IN ('a', 'b')")
    past = df.filter(F.col("ds") < dt.date(2022, 1, 20))
    terms = trend.design(past)
    ahead = trend.future(trend.fit(past, ["w"], terms), ["w"], terms, 28)
    assert ahead.count() == 56
    both = ahead.join(df, ["w", "ds"]).collect()
    assert np.mean([abs(r.y - r.yhat) / r.y for r in both]) < 0.05
    assert np.mean([r.yhat_lower <= r.y <= r.yhat_upper for r in both]) > 0.75
    errors = {r.w: r for r in trend.held_out(df, ["w"]).collect()}
    assert all(r.mape < 1.1 * r.naive_mape and r.n > 20 for r in errors.values())


def test_empty_series(spark):
    empty = frame(spark, []).limit(0)
    assert trend.fit(empty, ["w"]).count() == 0 and trend.held_out(empty, ["w"]).count() == 0


def test_distinct_ids_of_any_period(spark):
    rng = random.Random(3)
    rows = [(DAY0 + dt.timedelta(days=rng.randrange(90)), rng.choice("ab"), rng.choice([None, rng.randrange(50), rng.randrange(10**9), -rng.randrange(99)])) for _ in range(2000)]
    sets = rollup.daily_sets(spark.createDataFrame(rows, "d date, g string, id long"), F.col("d"), F.col("id"), ["g"])
    want = {}
    for d, g, i in rows:
        if i is not None:
            want.setdefault((d.month, g), set()).add(i)
    assert {(r.m, r.g): r.n for r in rollup.distinct_ids(sets, F.month("date").alias("m"), "g").collect()} == {k: len(v) for k, v in want.items()}
    whole = rollup.distinct_ids(sets, F.lit("all").alias("p")).first()
    assert whole.n == len({i for _, _, i in rows if i is not None})


@pytest.mark.parametrize("values", ["uniform", "ties"])
def test_percentiles_of_merged_sketches(spark, values):
    rng = random.Random(4)
    rows = [(DAY0 + dt.timedelta(days=rng.randrange(60)), rng.random() if values == "uniform" else float(rng.randrange(4))) for _ in range(20_000)] + [(DAY0, None)]
    df = spark.createDataFrame(rows, "d date, x double")
    shares = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    sketches = rollup.daily_sketches(df, F.col("d"), F.col("x"))
    est = rollup.percentiles(sketches, shares, F.month("date").alias("period"))
    assert sum(r.n for r in est.collect()) == 20_000
    errors = rollup.rank_error(df, est, F.month("d"), F.col("x"), shares).collect()
    assert len(errors) == 2 and all(0 <= r[c] <= 0.01 for r in errors for c in shares)

"""Order statistics, frequent values and uniqueness that no task holds whole: results by brute force, and plans."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from servista.operators import frequent, profile, quality as q, selection


def plan_of(df):
    return df._jdf.queryExecution().toString()


SPECIAL = [0.0, -0.0, 1.5, -1.5, 1e-320, -1e-320, 1e308, -1e308, math.inf, -math.inf, 5.0, 5.0, 5.0]


def test_bits_sort_as_values_do(spark):
    rng = random.Random(1)
    values = [*SPECIAL, math.nan, *[rng.gauss(0, 10 ** rng.randrange(-9, 9)) for _ in range(300)]]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", selection.ordered_bits("x").alias("b"))
    got = [(r.x, r.b % 2**64, r.back) for r in df.select("x", "b", selection.value_of_bits("b").alias("back")).collect()]
    assert all(x == back or (x != x and back != back) for x, _, back in got)
    plain = sorted((b, x) for x, b, _ in got if x == x)
    assert [x for _, x in plain] == sorted(x for x, _, _ in got if x == x)
    assert {b for x, b, _ in got if x != x}.pop() > max(b for x, b, _ in got if x == x)
    assert len({b for x, b, _ in got if x == 0}) == 1


@pytest.mark.parametrize("digit, held", [(16, 0), (32, 0), (16, None)])
def test_quantiles_equal_numpy(spark, monkeypatch, digit, held):
    monkeypatch.setattr(selection, "DIGIT", digit)
    rng = random.Random(2)
    rows = [("hot", rng.choice([1.0, 2.5, -3.0, rng.gauss(0, 1e6)])) for _ in range(3000)]
    rows += [(None, rng.random()) for _ in range(17)] + [("one", 7.25), ("none", None), ("two", -1.0), ("two", 2.0), ("two", None)]
    shares = {"low": 0.0, "a": 0.1, "half": 0.5, "b": 0.975, "high": 1.0}
    got = {r.g: r for r in selection.quantiles(spark.createDataFrame(rows, "g string, x double"), "x", shares, ["g"], held).collect()}
    for g in {r[0] for r in rows}:
        own = [x for h, x in rows if h == g and x is not None]
        assert got[g].n == len(own)
        for name, share in shares.items():
            assert got[g][name] == (pytest.approx(float(np.quantile(own, share)), rel=1e-12) if own else None)


def test_quantiles_of_a_whole_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    for held in (-1, None):
        assert tuple(selection.quantiles(df, "x", {"p": 0.25, "m": 0.5}, held=held).first()) == (25.0, 50.0, 101, 50.0)
        assert tuple(selection.quantiles(df.limit(0), "x", {"p": 0.25}, held=held).first()) == (None, 0, None)
        assert selection.quantiles(df.limit(0).withColumn("g", F.lit(1)), "x", {"p": 0.25}, ["g"], held).count() == 0


def test_selection_counts_before_the_shuffle(spark, monkeypatch):
    """However many rows a group has, a pass shuffles at most a count for each digit and task."""
    seen = []
    whole = selection._kept
    monkeypatch.setattr(selection, "_kept", lambda df, path: seen.append(plan_of(df)) or whole(df, path))
    selection.quantiles(spark.range(20_000).selectExpr("CAST(id % 977 AS double) AS x", "'hot' AS g"), "x", {"p": 0.5}, ["g"], 1000).collect()
    passes = [p for p in seen if "digit" in p]
    assert len(passes) == 4 and all("partial_count" in p and "SinglePartition" not in p for p in passes)


def skewed(seed, n=4000):
    rng = random.Random(seed)
    return [rng.choice([f"v{int(rng.paretovariate(0.7))}", f"v{rng.randrange(3000)}", "hot", None]) for _ in range(n)]


def plain_top(values, k):
    return sorted(((v, n) for v, n in Counter(values).items()), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]


@pytest.mark.parametrize("counters", [2, 16, 1 << 14])
@pytest.mark.parametrize("k", [1, 7, 10_000])
def test_top_values_are_exact(spark, monkeypatch, counters, k):
    monkeypatch.setattr(frequent, "MOST", 1 << 10)
    values = skewed(k)
    df = spark.createDataFrame([(v,) for v in values], "x string").repartition(3)
    assert [tuple(r) for r in frequent.top_values(df, k, counters).collect()] == plain_top(values, k)


def test_summaries_never_undercount_more_than_they_say(spark):
    values = [v for v in skewed(5) if v]
    df = spark.createDataFrame([(v,) for v in values], "x string").repartition(4)
    rows = frequent.summaries(df, 20).collect()
    missed, est, true = sum(r.n for r in rows if r.value is None), Counter(), Counter(values)
    for r in rows:
        est[r.value] += r.n if r.value is not None else 0
    assert 0 < missed < len(values) / 4 and all(est[v] <= n <= est[v] + missed for v, n in true.items())
    assert len(rows) <= 4 * 21


def test_value_counts_gather_no_values(spark):
    df = spark.createDataFrame([(v,) for v in skewed(6)], "x string")
    plain = df.repartition(3)
    for top in (None, 3):
        text = plan_of(profile.value_counts(plain, "x", top))
        assert "Window" not in text
    got = profile.value_counts(plain, "x", 3).collect()
    assert [(r.value, r.n) for r in got] == plain_top(skewed(6), 3) and got[0].pct == pytest.approx(100 * got[0].n / 4000)
    assert profile.value_counts(plain.limit(0), "x", 3).count() == 0


def test_uniqueness_rules_share_two_scans(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.randrange(200), rng.choice(["a", "b", None]), rng.choice([0.0, -0.0, 1.0 * i, None])) for i in range(300)]
    spark.createDataFrame(rows, "a long, b int, s string, x double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rules = [q.rule("unique", c, mostly=0.3) for c in "absx"] + [q.rule("unique_combination", *c) for c in ("ab", "bs", "sb", "sx", "bx", "ax")]
    got = {r.rule: (r.checked, r.good, r.success) for r in q.unique_rules(df, rules).collect()}
    for r in rules:
        at = ["absx".index(c) for c in r.columns]
        keys = [tuple(x[i] + 0.0 if isinstance(x[i], float) else x[i] for i in at) for x in rows]
        keys = [k for k in keys if r.kind != "unique" or k[0] is not None]
        good = sum(n for n in Counter(keys).values() if n == 1)
        assert got[r.label] == (len(keys), good, good / len(keys) >= r.mostly), r
    scans = plan_of(q.unique_rules(df, rules)).split("== Physical Plan ==")[1].count("/t]")
    assert scans == 1  # and one before it, for the hashes
    assert [tuple(r)[4:] for r in q.unique_rules(df.limit(0), rules[:1]).collect()] == [(0, 0, True)]


def test_hashes_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(q.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (3, None)], "k int, rule string")
    assert {r.rule: (r.checked, r.good) for r in q.unique_rules(df, [q.rule("unique", "k"), q.rule("unique", "rule"), q.rule("unique_combination", "rule", "k")]).collect()} == {"unique:k": (4, 2), "unique:rule": (2, 0), "unique_combination:rule,k": (4, 2)}


@pytest.mark.parametrize("together", [1, 3])
def test_uniqueness_of_many_keys_goes_in_rounds(spark, tmp_path, monkeypatch, together):
    n, path = 100_000, tmp_path / "t"
    monkeypatch.setattr(q, "ENTRIES", together * n, raising=False)
    i = F.col("id")
    spark.range(n).select((i * 7919 % 30011).alias("a"), (i * 31 % 997).alias("b"), (i * 17 % 50021).cast("double").alias("x"), (i % 7).cast("int").alias("l")).write.parquet(str(path))
    df = spark.read.parquet(str(path))
    keys = ["a", "b", "x", "l", "ab", "ax", "bx", "xl", "abx", "axl"]
    folders = [Path(str(d)) for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()] + [Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))]
    files = lambda: {f: f.stat().st_size for d in folders for f in d.rglob("*") if f.is_file()}
    before = files()
    got = {r.column: (r.checked, r.good) for r in q.unique_rules(df, [q.rule("unique" if len(k) == 1 else "unique_combination", *k) for k in keys]).collect()}
    left = sum(size for f, size in files().items() if f not in before)
    rows = df.collect()
    for k in keys:
        count = Counter(tuple(r[c] for c in k) for r in rows)
        assert got[",".join(k)] == (n, sum(m == 1 for m in count.values())), k
    assert left < 4 * sum(f.stat().st_size for f in path.glob("*.parquet"))  # the last round's shuffle


def test_null_profile_of_many_columns_is_two_scans(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([None, 0.0, -0.0, 1.5]), rng.choice([None, "a", "b", ""]), rng.randrange(5), rng.choice([None, [1, 2], [2]]), None) for _ in range(200)]
    schema = "x double, `s.t` string, i int, l array<int>, n string"
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).withColumns({f"c{k}": F.col("i") * k for k in range(20)}).write.parquet(path)
    got = {r.column: r for r in profile.null_profile(spark.read.parquet(path)).collect()}
    for k, name in enumerate(("x", "s.t", "i", "l", "n")):
        own = [repr(r[k] + 0.0 if isinstance(r[k], float) else r[k]) for r in rows if r[k] is not None]
        assert (got[name].n_rows, got[name].n_values, got[name].n_distinct) == (200, len(own), len(set(own)))
        assert got[name].null_rate == pytest.approx(1 - len(own) / 200)
    assert (got["c3"].n_distinct, got["c3"].sample, got["n"].sample, got["n"].recommendation) == (5, "0", None, "nullable")
    plan = profile.null_profile(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Expand" not in plan
    assert {r.n_rows for r in profile.null_profile(spark.read.parquet(path).limit(0)).collect()} == {0}

"""Clustered files, deep pages, versions at many moments, and streams with windows and counters, by brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from servista.operators import history, layout, paging, quality as q
from servista.streaming import counters, windows


def test_bits_alternate(spark):
    df = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)], "a int, b int")
    got = {(r.a, r.b): r.z for r in df.select("a", "b", layout.z_order([F.col("a"), F.col("b")], 3).alias("z")).collect()}
    for (a, b), z in got.items():
        assert z == int("".join(f"{(a >> k) & 1}{(b >> k) & 1}" for k in (2, 1, 0)), 2)


def test_files_are_skipped_for_each_column_alone(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([7, rng.randrange(50)]), rng.choice("abcdefghij"), i) for i in range(4000)] + [(None, None, -1)]
    df = spark.createDataFrame(rows, "ward int, type string, i int").repartition(4)
    path = str(tmp_path / "t")
    layout.write_clustered(df, path, ["ward", "type"], 16)
    back = spark.read.parquet(path)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    ranges = layout.file_ranges(back, ["ward", "type"])
    sizes = [r.rows for r in ranges.collect()]
    assert len(sizes) >= 12 and max(sizes) < 4 * 4000 / 16  # a ward that half of all rows have doesn't fill one file
    for column in ("ward", "type"):
        read = [r.files_read / r.files for r in layout.files_read(ranges, back.filter(f"{column} IS NOT NULL").select(column), column).collect()]
        assert sum(read) / len(read) < 0.55 and max(read) < 0.9


def test_bounds_of_few_and_no_values(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "a int")
    assert layout.bounds(df, "a") == [] and layout.bounds(df.limit(0), "a") == []
    assert layout.bounds(spark.createDataFrame([(1,), (2,), (2,)], "a int"), "a") == [2]


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_pages_equal_a_sort(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice([None, 3, rng.randrange(40)]), rng.choice([None, "x", "y"]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(99)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, s string, t timestamp, i int").repartition(3)
    orders = [[("a", False), ("s", True), ("i", False)], [("s", True), ("t", False), ("i", True)]]
    for order in orders:
        columns = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
        want = [r.i for r in df.orderBy(*columns).collect()]
        for offset in (137, 299) if most == 1 else (0, 137, 290, 299, 300, 1000):
            assert [r.i for r in paging.page(df, order, 12, offset, most).collect()] == want[offset : offset + 12]
    assert paging.page(df, orders[0], 5, 0, most).columns == df.columns and paging.page(df.limit(0), orders[0], 5, 3, most).count() == 0


def test_a_deep_page_reads_one_range(spark, monkeypatch):
    df = spark.range(20_000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(10**9)))
    seen = []
    own = type(df).orderBy
    monkeypatch.setattr(type(df), "orderBy", lambda self, *c: seen.append(self.count()) or own(self, *c))
    got = paging.page(df, [("v", True), ("id", True)], 10, 19_990, most=1000).collect()
    monkeypatch.undo()
    assert [r.id for r in got] == [r.id for r in df.orderBy("v", "id").collect()[-10:]]
    assert seen[-1] <= 1000


T0 = dt.datetime(2024, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


@pytest.mark.parametrize("unit", [3600, 86_400, 10**7])
def test_versions_at_many_moments(spark, unit):
    rng = random.Random(unit)
    rows = []
    for k in range(150):
        a = rng.randrange(-500, 2200)
        rows.append((k, at(a), rng.choice([None, at(a), at(a + rng.randrange(1, 9)), at(a + rng.randrange(1, 3000))])))
    moments = sorted({at(rng.randrange(2000)) for _ in range(60)} | {at(0), at(24), at(1999.5)})
    df = spark.createDataFrame(rows, f"k int, {history.START} timestamp, {history.END} timestamp")
    met = history.open_at(df, spark.createDataFrame([(m,) for m in [*moments, None]], "m timestamp"), "m", unit)
    assert sorted((r.k, r.m) for r in met.collect()) == sorted((k, m) for k, a, z in rows for m in moments if a <= m and (z is None or z > m))
    text = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in text and "__size" in text and "Cartesian" not in met._jdf.queryExecution().executedPlan().toString()
    assert history.open_at(df, spark.createDataFrame([], "m timestamp"), "m").count() == 0


def test_late_rows_count_within_the_watermark(spark, tmp_path):
    def run(hours):
        spark.createDataFrame([(at(h),) for h in hours], "t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("t timestamp").parquet(str(tmp_path / "in"))
        windows.follow_counts(windows.windowed_counts(stream, "t", "1 hour", "2 hours"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {(r.window_start, r.n) for r in spark.read.schema("window_start timestamp, window_end timestamp, n long").parquet(str(tmp_path / "out")).collect()}

    assert run([0.1, 1.2, 1.9, 5.5]) == {(at(0), 1), (at(1), 2)}  # up to 3:30
    assert run([3.7, 0.5, 1.5, 9.0]) == {(at(0), 1), (at(1), 2), (at(3), 1), (at(5), 1)}  # 0:30 and 1:30 are dropped
    assert run([9.9, 12.5]) == {(at(0), 1), (at(1), 2), (at(3), 1), (at(5), 1), (at(9), 2)}


def test_counters_of_a_batch_that_fails_and_is_repeated(spark, tmp_path):
    rules = [q.rule("not_null", "k", action="drop"), q.rule("between", "x", low=0, high=9)]
    folder, root, broken = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "broken"
    broken.touch()
    land = lambda rows: spark.createDataFrame(rows, "k int, x int").coalesce(1).write.mode("append").parquet(folder)
    flag = str(broken)

    def stream():
        import os

        @F.udf("int")
        def dies(x):
            if x == 99 and os.path.exists(flag):
                raise ValueError("bad row")
            return x

        return spark.readStream.schema("k int, x int").parquet(folder).withColumn("x", dies("x"))

    land([(1, 1), (None, 2), (3, 50), (None, 11)])
    counters.follow_rules(stream(), rules, root)
    land([(5, 99), (6, 1)])
    with pytest.raises(Exception, match="bad row"):
        counters.follow_rules(stream(), rules, root)
    seen = lambda: {(r.batch, r.counter): r.n for r in counters.read_counters(spark, f"{root}/counters").collect()}
    first = {(0, "rows"): 4, (0, "accepted"): 2, (0, "not_null:k"): 2, (0, "between:x"): 2}
    assert seen() == first
    broken.unlink()
    for _ in range(2):  # the second run has nothing to do
        counters.follow_rules(stream(), rules, root)
        assert seen() == first | {(1, "rows"): 2, (1, "accepted"): 2, (1, "not_null:k"): 0, (1, "between:x"): 1}
    rows = counters.read_rows(spark, root)
    assert {(r.k, r.x, r.accepted, tuple(r.violations)) for r in rows.collect()} == {(1, 1, True, ()), (None, 2, False, ("not_null:k",)), (3, 50, True, ("between:x",)), (None, 11, False, ("not_null:k", "between:x")), (5, 99, True, ("between:x",)), (6, 1, True, ())}

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from servista.operators import changes, history
from servista.streaming.history import HistoryTable

T0 = dt.datetime(2024, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def feed(spark, rows):
    return spark.createDataFrame(rows, "k string, seq timestamp, status string, note string, _ingestion_timestamp timestamp")


def apply(df, track=None):
    return history.apply_changes(df, "k", "seq", track=track, except_columns=("seq", "_ingestion_timestamp"), tie=["_ingestion_timestamp"])


def brute(rows, track):
    """Versions by plain Python: last of equal (key, sequence), then changes of the tracked values."""
    out, by_key = set(), {}
    for k, seq, status, note, ing in rows:
        if k is not None and seq is not None:
            old = by_key.setdefault(k, {}).get(seq)
            if old is None or ing > old[2]:
                by_key[k][seq] = (status, note, ing)
    for k, seqs in by_key.items():
        kept = []
        for seq in sorted(seqs):
            state = seqs[seq][: 1 if track else 2]
            if not kept or kept[-1][1] != state:
                kept.append((seq, state))
        for i, (seq, state) in enumerate(kept):
            out.add((k, state[0], seq, kept[i + 1][0] if i + 1 < len(kept) else None))
    return out


def result(df):
    return {(r.k, r.status, r[history.START], r[history.END]) for r in df.collect()}


rows_ = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 5).map(at)), st.sampled_from(["OPEN", "COMPLETED", None]), st.sampled_from(["x", None])), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_, track=st.booleans(), seed=st.randoms())
def test_any_order_gives_the_same_history(spark, rows, track, seed):
    rows = [(*r, at(100 + i)) for i, r in enumerate(rows)]
    want = brute(rows, track)
    seed.shuffle(rows)
    got = apply(feed(spark, rows), ["status"] if track else None)
    assert result(got) == want
    open_ = [r.k for r in history.current(got).collect()]
    assert len(open_) == len(set(open_)) == len({w[0] for w in want})


def test_point_in_time_and_durations(spark):
    df = feed(spark, [("a", at(0), "OPEN", "x", at(0)), ("a", at(5.9), "COMPLETED", "x", at(9))])
    h = apply(df)
    assert [r.status for r in history.as_of(h, F.lit(at(5))).collect()] == ["OPEN"]
    assert [r.status for r in history.as_of(h, F.lit(at(6))).collect()] == ["COMPLETED"]
    assert history.as_of(h, F.lit(at(-1))).count() == 0
    s = history.status_history(h, "k", F.lit(at(10)), ["status"])
    assert [(r.hours_in_status, r.version_number, r.is_current) for r in s.orderBy("version_number").collect()] == [(5, 1, False), (4, 2, True)]
    t = history.transitions(s.withColumn("i", F.lit(1)), "k", ["i"]).collect()
    assert [(r.from_status, r.to_status, r.transition_count, r.median_hours_before_transition) for r in t] == [("OPEN", "COMPLETED", 1, 5)]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), ("a", 3, "z"), (None, 9, "n"), ("b", None, "q")], "k string, o int, v string")
    assert {(r.k, r.v) for r in changes.latest_per_key(df, "k", "o").collect()} == {("a", "z"), ("b", "q")}


def test_batches_equal_one_batch(spark, tmp_path):
    rows = [("a", at(3), "OPEN", None, at(3)), ("b", at(1), "OPEN", None, at(1)), ("a", at(1), "NEW", None, at(4)), ("a", at(2), "NEW", "late", at(5)), ("c", at(2), "OPEN", None, at(6))]
    table = HistoryTable(spark, str(tmp_path / "h"), "k", "seq", buckets=4, track=["status"], except_columns=("seq", "_ingestion_timestamp"), tie=["_ingestion_timestamp"])
    table.add(feed(spark, rows[:2]), 0)
    table.add(feed(spark, rows[2:]), 1)
    whole = result(apply(feed(spark, rows), ["status"]))
    assert result(table.read()) == whole
    table.add(feed(spark, rows[2:]), 1)
    assert result(table.read()) == whole


def test_a_crash_keeps_the_batch_before(spark, tmp_path, monkeypatch):
    rows = [(f"k{i}", at(i), "OPEN", None, at(i)) for i in range(20)]
    make = lambda: HistoryTable(spark, str(tmp_path / "h"), "k", "seq", buckets=4, track=["status"], except_columns=("seq", "_ingestion_timestamp"), like=feed(spark, []).schema)
    assert make().read().count() == 0
    make().add(feed(spark, rows), 0)
    for step in ("_point", "_history"):  # before the pointer is made, and before the history is
        with monkeypatch.context() as m:
            m.setattr(HistoryTable, step, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                make().add(feed(spark, [("k1", at(99), "DONE", None, at(99))]), 1)
        assert make().read().count() == 20
    make().add(feed(spark, [("k1", at(99), "DONE", None, at(99))]), 1)
    make().add(feed(spark, [("k2", at(99), "DONE", None, at(99))]), 2)
    got = make().read()
    assert got.count() == 22 and {r.k for r in got.collect()} == {r[0] for r in rows}


def test_a_crash_while_a_batch_is_repeated_changes_nothing(spark, tmp_path, monkeypatch):
    """Each write of a batch that the pointer names already dies in turn, before it begins and half way."""
    table = HistoryTable(spark, str(tmp_path / "h"), "k", "seq", buckets=4, track=["status"], except_columns=("seq", "_ingestion_timestamp"))
    first = [(f"k{i}", at(i), "OPEN", None, at(i)) for i in range(9)]
    second = [("k1", at(50), "DONE", None, at(50)), ("k2", at(0), "NEW", None, at(51)), ("new", at(3), "OPEN", None, at(52))]
    table.add(feed(spark, first), 0)
    table.add(feed(spark, second), 1)
    want = result(table.read())
    open_reader = table.read()
    writer = type(spark.range(1).write)
    for dies_at in range(3):
        for after in (False, True):
            calls = iter(range(9))

            def parquet(self, path, f=writer.parquet, calls=calls, dies_at=dies_at, after=after):
                here = next(calls) == dies_at
                if here and not after:
                    raise OSError("dies")
                f(self, path)
                if here:
                    raise OSError("dies")

            with monkeypatch.context() as m:
                m.setattr(writer, "parquet", parquet)
                if dies_at == 2:
                    m.setattr(HistoryTable, "_point", lambda *a: (_ for _ in ()).throw(OSError("dies")))
                with pytest.raises(OSError, match="dies"):
                    table.add(feed(spark, second), 1)
            assert result(table.read()) == result(open_reader) == want
    table.add(feed(spark, second), 1)
    assert result(table.read()) == want
    table.vacuum()
    assert result(table.read()) == want
    assert len(list((tmp_path / "h" / "log" / "batch=1").glob("attempt=*"))) == 2  # the last two pointers' own
    table.vacuum(keep=1)
    assert len(list((tmp_path / "h" / "log" / "batch=1").glob("attempt=*"))) == 1 and result(table.read()) == want
    table.add(feed(spark, [("k1", at(60), "OPEN", None, at(60))]), 2)
    assert result(table.read()) == result(apply(feed(spark, [*first, *second, ("k1", at(60), "OPEN", None, at(60))]), ["status"]))


def test_a_batch_reads_the_log_of_its_buckets(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "h"), "k", "seq", buckets=8, track=["status"], except_columns=("seq", "_ingestion_timestamp"))
    table.add(feed(spark, [(f"k{i}", at(i), "OPEN", None, at(i)) for i in range(40)]), 0)
    seen = []
    table._history = lambda changes, f=table._history: seen.append(sorted(changes.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])) or f(changes)
    table.add(feed(spark, [("k1", at(99), "DONE", None, at(99))]), 1)
    buckets = {x.split("__bucket=")[1].split("/")[0] for x in seen[0]}
    assert len(buckets) == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    spark.createDataFrame([(1, at(0), at(1))], "k long, a timestamp, b timestamp").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    pushed = plan_of(changes.changed_since(df, ["a", "b"], F.lit(at(2)))).split("PushedFilters: ")[1].split("]")[0]
    assert "GreaterThan(a" in pushed and "GreaterThan(b" in pushed and "Or(" in pushed
    assert "SortAggregate" not in plan_of(changes.latest_per_key(df, "k", "a"))
    from servista.operators import profile

    assert "Expand" not in plan_of(profile.null_profile(df))


@pytest.mark.parametrize("h", [59 / 60, 61 / 60, -61 / 60])
def test_hours_are_cut_towards_zero(spark, h):
    from servista.functions.dates import hours_between

    r = spark.range(1).select(hours_between(F.lit(at(0)), F.lit(at(h))).alias("h")).first()
    assert r.h == int(h)

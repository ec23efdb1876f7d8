"""History kept by state: the processor against apply_changes' definition, and streams that stop, crash and start again."""

import random

import pytest
from pyspark.sql import Row, functions as F, types as T

from servista.operators import history
from servista.streaming.versions import END, REMOVED, START, VersionState, VersionStream

from .test_history import at, brute, feed, result


class Value:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x


class Items:
    """A list state; reads are counted."""

    def __init__(self):
        self.x, self.reads = [], 0

    def get(self):
        self.reads += 1
        return iter(self.x)

    def put(self, x):
        self.x = list(x)

    def appendList(self, x):
        self.x += x


def processor(kept, tracked):
    p = VersionState(T.StructType(), T.StructType(), ["k", *[f"v{i}" for i in range(kept)], START, END, "revision", REMOVED], kept, tracked)
    p.head, p.log = Value(), Items()
    return p


def take_in(p, table, rows):
    """Rows (sequence, values..., order) of one key; the emitted rows go to table by start."""
    emitted = list(p.handleInputRows(("k",), iter([Row("k", *r) for r in rows]), None))
    for _, *values, start, end, revision, removed in (tuple(r) for r in emitted):
        assert start not in table or table[start][2] < revision
        table[start] = (tuple(values), end, revision, removed)
    return emitted


@pytest.mark.parametrize("tracked", [[0], [0, 1]])
def test_any_batches_give_the_history(tracked):
    rng = random.Random(len(tracked))
    for _ in range(300):
        rows = [(rng.randrange(6), rng.choice(["A", "B", None]), rng.choice([1.0, float("nan")]), rng.choice([None, 1, 2])) for _ in range(rng.randrange(1, 14))]
        rows = [(*r, i) for i, r in enumerate(rows)]  # the hash
        p, table, i = processor(2, tracked), {}, 0
        while i < len(rows):
            j = i + rng.randrange(1, 4)
            take_in(p, table, rows[i:j])
            i = j
        best = {}
        for r in rows:
            order = [(x is not None, x or 0) for x in r[3:]]
            if r[0] not in best or order > best[r[0]][0]:
                best[r[0]] = (order, r)
        kept = []
        for s in sorted(best):
            r = best[s][1]
            if not kept or repr([kept[-1][1:3][i] for i in tracked]) != repr([r[1:3][i] for i in tracked]):
                kept.append(r)
        want = {r[0]: (repr(r[1:3]), kept[i + 1][0] if i + 1 < len(kept) else None) for i, r in enumerate(kept)}
        assert {s: (repr(v), end) for s, (v, end, _, removed) in table.items() if not removed} == want


def test_a_late_row_alters_its_neighbours_only_and_a_new_one_reads_no_list():
    p, table = processor(1, [0]), {}
    take_in(p, table, [(10 * i, "AB"[i % 2], 0) for i in range(50)])
    assert p.log.reads == 0
    assert [tuple(r)[1:4] for r in take_in(p, table, [(500, "A", 0), (510, "A", 1)])] == [("B", 490, 500), ("A", 500, None)]
    assert p.log.reads == 0
    late = take_in(p, table, [(205, "B", 0)])  # A from 200 ends, B from 210 began at 205
    assert p.log.reads == 1
    assert sorted((r[2], r[3], r[5]) for r in late) == [(200, 205, False), (205, 220, False), (210, None, True)]
    assert take_in(p, table, [(205, "B", 0)]) == [] and len(p.log.x) == 53


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streams_stop_crash_and_start_again(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *map(at, range(9))]), rng.choice(["OPEN", "COMPLETED", None]), rng.choice(["x", None]), at(100 + i)) for i in range(60)]
    make = lambda: VersionStream(spark, str(tmp_path / "h"), "k", "seq", ["status"], ("seq", "_ingestion_timestamp"), ["_ingestion_timestamp"])
    schema, landing = feed(spark, []).schema, str(tmp_path / "in")
    land = lambda part: feed(spark, part).coalesce(1).write.mode("append").parquet(landing)
    land(rows[:20])
    land(rows[20:30])
    make().follow(stream(spark, schema, landing)).awaitTermination()
    assert result(make().read()) == brute(rows[:30], True)

    land(rows[30:])
    whole = VersionStream.follow
    dying = make()
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, f=type(spark.range(1).write).parquet: f(self, path) or (1 / 0 if "revisions/batch=2" in path else None))
    with pytest.raises(Exception, match="division by zero"):
        whole(dying, stream(spark, schema, landing)).awaitTermination()  # the batch is written, but not done
    monkeypatch.undo()
    make().follow(stream(spark, schema, landing)).awaitTermination()
    assert result(make().read()) == brute(rows, True)
    make().follow(stream(spark, schema, landing)).awaitTermination()  # nothing new
    assert result(make().read()) == brute(rows, True)
    same = history.apply_changes(feed(spark, rows), "k", "seq", ["status"], ("seq", "_ingestion_timestamp"), ["_ingestion_timestamp"])
    key = [c for c in same.columns]
    assert sorted(map(repr, same.select(*key).collect())) == sorted(map(repr, make().read().select(*key).collect()))
    sizes = {r.k: r.n for r in make().state_sizes().collect()}
    assert sizes == {k: len({r[1] for r in rows if r[0] == k and r[1]}) for k in "abc"}
    log = spark.read.parquet(str(tmp_path / "h" / "revisions"))
    assert log.filter(F.col(REMOVED)).count() > 0 and {START, END} <= set(log.columns)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")

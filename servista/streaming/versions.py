"""A Type-2 history kept by state: each batch of changes emits only the versions that it opens, closes, alters or removes.

State of a key: its open version and the sequence of its last row (a value), and all its rows (a list). A row after the last one
touches the value alone and is appended to the list unread; a late row reads its key's list, falls into place, and alters its
neighbours. The versions are a log of revisions in a folder by batch; a batch that is repeated, after a crash or not, starts
from the state before it and replaces its own part. The history is the last revision of each version (see read).

Rows and versions are those of servista.operators.history.apply_changes. A key is held by one task, as it is there.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from servista.functions.clean import METADATA
from servista.operators.history import END, START

#: State of this kind needs a store on disk, which also keeps large states out of the heap.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
REVISION, REMOVED = "__REVISION", "__REMOVED"
Change = tuple[Any, ...]


class VersionState(StatefulProcessor):
    """Rows of a key come as (key, sequence, kept columns, order columns); the order columns decide between rows of equal sequence."""

    def __init__(self, log: T.StructType, head: T.StructType, out: list[str], kept: int, tracked: list[int]):
        self.log_schema, self.head_schema, self.out, self.kept, self.tracked = log, head, Row(*out), kept, tracked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", self.head_schema)
        self.log = handle.getListState("log", self.log_schema)

    def close(self) -> None:
        pass

    def _order(self, change: Change) -> list:
        return [(False, 0) if x is None else (True, x) for x in change[1 + self.kept :]]

    def _last_of(self, changes: Iterable[Change]) -> list[Change]:
        """One row of each sequence, in order."""
        best: dict[Any, Change] = {}
        for c in changes:
            if c[0] not in best or self._order(c) > self._order(best[c[0]]):
                best[c[0]] = c
        return [best[s] for s in sorted(best)]

    def _state(self, values: Change, whole: bool = False) -> list:
        """Tracked values, or all, to be compared: NaN equals itself, as in Spark."""
        some = values if whole else [values[i] for i in self.tracked]
        return ["NaN" if isinstance(x, float) and x != x else x for x in some]

    def _versions(self, ordered: list[Change]) -> dict[Any, tuple[Change, Any]]:
        """By start: the kept values, and the end."""
        opened: list[Change] = []
        for c in ordered:
            if not opened or self._state(opened[-1][1:]) != self._state(c[1:]):
                opened.append(c)
        ends = [*[c[0] for c in opened[1:]], None]
        return {c[0]: (c[1 : 1 + self.kept], end) for c, end in zip(opened, ends, strict=False)}

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = self._last_of(tuple(r)[1:] for r in rows)
        if not new:
            return
        head = tuple(self.head.get()) if self.head.exists() else None
        if head is None or new[0][0] > head[1]:
            opened = [head[2:]] if head else []  # the open version stands for all rows so far
            was, now = self._versions(opened), self._versions([*opened, *new])
            self.log.appendList(new)
        else:
            old = [tuple(x) for x in self.log.get()]
            new = self._last_of([*old, *new])
            was, now = self._versions(self._last_of(old)), self._versions(new)
            self.log.put(new)
        revision, start = (head[0] + 1 if head else 0), max(now)
        self.head.update((revision, new[-1][0], start, *now[start][0]))
        changed = {s: v for s, v in now.items() if s not in was or self._state(was[s][0], whole=True) != self._state(v[0], whole=True) or was[s][1] != v[1]}
        removed = {s: v for s, (v, _) in was.items() if s not in now}
        for s, (values, end) in changed.items():
            yield self.out(*key, *values, s, end, revision, False)
        for s, values in removed.items():
            yield self.out(*key, *values, s, None, revision, True)


class VersionStream:
    """The history under `root`, kept from streams of changes with `key` and `sequence`; options as for apply_changes."""

    def __init__(self, spark: SparkSession, root: str, key: str, sequence: str, track: list[str] | None = None, except_columns: tuple[str, ...] = METADATA, tie: list[str] | None = None):
        self.spark, self.root, self.key, self.sequence = spark, root.rstrip("/"), key, sequence
        self.track, self.except_columns, self.tie = track, except_columns, tie or []

    def revisions(self, changes: DataFrame) -> DataFrame:
        """The stream of revisions: kept columns, start, end, revision of the key, and whether the version is removed."""
        kept = [c for c in changes.columns if c not in self.except_columns]
        values = [c for c in kept if c != self.key]
        rows = changes.filter(F.col(self.key).isNotNull() & F.col(self.sequence).isNotNull()).select(self.key, F.col(self.sequence).alias("__sequence"), *values, *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(self.tie)], F.xxhash64(*kept).alias("__hash"))
        moments = {f.name for f in rows.schema if isinstance(f.dataType, T.TimestampType)}  # as numbers, the state knows no zone
        rows = rows.select(*[F.unix_micros(f"`{c}`").alias(c) if c in moments else F.col(f"`{c}`") for c in rows.columns])
        fields = {f.name: T.StructField(f.name, f.dataType) for f in rows.schema}
        log = T.StructType([f for n, f in fields.items() if n != self.key])
        start = T.StructField(START, fields["__sequence"].dataType)
        head = T.StructType([T.StructField("revision", T.LongType()), fields["__sequence"], start, *[fields[c] for c in values]])
        out = T.StructType([fields[self.key], *[fields[c] for c in values], start, T.StructField(END, start.dataType), T.StructField(REVISION, T.LongType()), T.StructField(REMOVED, T.BooleanType())])
        tracked = [i for i, c in enumerate(values) if self.track is None or c in self.track]
        made = rows.groupBy(self.key).transformWithState(VersionState(log, head, out.names, len(values), tracked), out, "Update", "None")
        again = moments | ({START, END} if "__sequence" in moments else set())
        return made.select(*[F.timestamp_micros(f"`{c}`").alias(c) if c in again else F.col(f"`{c}`") for c in made.columns])

    def follow(self, changes: DataFrame) -> StreamingQuery:
        """Take in all that a stream of changes has now, batch by batch, from where the last run ended."""

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.root}/revisions/batch={number}")

        with _settings(self.spark, STORE):
            return self.revisions(changes).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """The history as of the last batch: kept columns, __START_AT and __END_AT."""
        log = self.spark.read.option("basePath", f"{self.root}/revisions").parquet(f"{self.root}/revisions/batch=*").drop("batch")
        values = [c for c in log.columns if c not in (self.key, START, REVISION)]
        last = log.groupBy(self.key, START).agg(F.max_by(F.struct(*values), REVISION).alias("v"))
        return last.filter(f"NOT v.{REMOVED}").select(self.key, *[F.col(f"v.`{c}`").alias(c) for c in values if c not in (END, REMOVED)], START, F.col(f"v.{END}").alias(END))

    def state_sizes(self) -> DataFrame:
        """Rows that the state holds for each key, read from the state store of the last batch."""
        log = self.spark.read.format("statestore").option("path", f"{self.root}/checkpoint").option("stateVarName", "log").load()
        return log.groupBy(F.col(f"key.`{self.key}`").alias(self.key)).agg(F.count("*").alias("n"))


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for this block; a stream keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

"""Keeping a Type-2 history up to date from a stream of changes without a table format that can merge.

Keys are dealt into a fixed number of hash buckets. The change log and the history are folders by bucket; a batch
appends its changes to the log and rebuilds just the buckets it touches from their log, into a new version of each.
A pointer file names the folders that count. Every attempt writes folders of its own, and pointers are numbered, never changed,
and come to be by a rename: readers see all of a batch or none, and a crash at any point, also while a finished batch is taken in
again, leaves the table as it was before. vacuum() deletes what no late pointer names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from servista.operators.history import apply_changes


class HistoryTable:
    """like: the schema of the changes, with which a table that took in nothing yet can be read."""

    def __init__(self, spark: SparkSession, root: str, key: str, sequence: str, buckets: int = 64, like: T.StructType | None = None, **options):
        self.spark, self.root, self.key, self.sequence, self.buckets, self.like, self.options = spark, root.rstrip("/"), key, sequence, buckets, like, options

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/pointers")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _pointer(self, number: int | None = None) -> dict[str, dict[str, str]]:
        """Of the pointer (the highest one): log has the attempt of each batch, history the attempt of each bucket."""
        found = self._pointers()
        if not found:
            return {"log": {}, "history": {}}
        return json.loads(self.spark.read.text(f"{self.root}/pointers/{found[-1] if number is None else number:012d}.json", wholetext=True).first()[0])

    def _point(self, named: dict[str, dict[str, str]]) -> None:
        number = max(self._pointers(), default=-1) + 1
        fs, new = self._fs(f"{self.root}/pointers/_{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(named).encode()))
        out.close()
        if not fs.rename(new, self._fs(f"{self.root}/pointers/{number:012d}.json")[1]):
            raise OSError(f"another writer made pointer {number} of {self.root}")

    def _history(self, changes: DataFrame) -> DataFrame:
        return apply_changes(changes, self.key, self.sequence, **self.options)

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in one batch; taking it in again changes nothing."""
        self.like = self.like or batch.schema
        log, attempt, named = f"{self.root}/log", uuid.uuid4().hex, self._pointer()
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        dealt = batch.filter(F.col(self.key).isNotNull()).withColumn("__bucket", bucket)
        own = f"{log}/batch={number}/attempt={attempt}"
        dealt.write.partitionBy("__bucket").parquet(own)
        fs, p = self._fs(own)
        touched = sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(p) if x.isDirectory())
        if not touched:
            return
        counted = named["log"] | {str(number): attempt}
        schema = T.StructType([*batch.schema, T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType()), T.StructField("__bucket", T.IntegerType())])
        changes = self.spark.read.schema(schema).option("basePath", log).parquet(*[f"{log}/batch={n}/attempt={a}" for n, a in counted.items()])
        history = self._history(changes.filter(F.col("__bucket").isin(touched)).select(*batch.columns)).withColumn("__bucket", bucket)
        history.write.partitionBy("__bucket").parquet(f"{self.root}/history/attempt={attempt}")
        self._point({"log": counted, "history": named["history"] | {str(b): attempt for b in touched}})

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders that none of the last `keep` pointers names: those of attempts that died, and of versions replaced since."""
        late = [self._pointer(n) for n in self._pointers()[-keep:]]
        logs = {f"batch={n}/attempt={a}" for p in late for n, a in p["log"].items()}
        versions = {f"attempt={a}" for p in late for a in p["history"].values()}
        for top, named, depth in ((f"{self.root}/log", logs, 2), (f"{self.root}/history", versions, 1)):
            fs, p = self._fs(top)
            found = fs.globStatus(self._fs(f"{top}/batch=*/attempt=*" if depth == 2 else f"{top}/attempt=*")[1]) or []
            for x in found:
                if "/".join(x.getPath().toString().split("/")[-depth:]) not in named:
                    fs.delete(x.getPath(), True)

    def read(self) -> DataFrame:
        """The history as of the last finished batch."""
        named = self._pointer()["history"]
        if named:
            return self.spark.read.parquet(*[f"{self.root}/history/attempt={a}/__bucket={b}" for b, a in named.items()])
        if self.like is None:
            raise ValueError("the table took in nothing yet; name the schema of its changes")
        return self._history(self.spark.createDataFrame([], self.like))

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in all that a stream of changes has now, batch by batch."""
        self.like = self.like or changes.schema
        return changes.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

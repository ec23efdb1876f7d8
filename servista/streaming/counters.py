"""Quality rules on a stream: accepted and quarantined rows from one pass, and counters of each batch in a table."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from servista.operators.quality import Rule, with_violations

ACCEPTED = "accepted"


class BatchCounters(StreamingQueryListener):
    """Writes what streams observe under `name` to a file for each batch; a batch that is done again replaces its file.

    Spark tells listeners of a batch when it is done, so one that failed has no counters until it is repeated and ends. A driver
    that dies between a batch's commit and its counters loses them; its rows still have their violations.
    """

    def __init__(self, spark: SparkSession, table: str, name: str):
        self.spark, self.table, self.name = spark, table.rstrip("/"), name

    def _path(self, batch: int):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.table}/batch={batch}/counters.json")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        fs, p = self._path(event.progress.batchId)
        out = fs.create(p, True)
        out.write(bytearray("\n".join(json.dumps({"counter": k, "n": v}) for k, v in seen.asDict().items()).encode()))
        out.close()

    def wait(self, batch: int, seconds: float = 30.0) -> None:
        """Until the counters of a batch are written: listeners hear of it a little later than the stream itself."""
        fs, p = self._path(batch)
        until = time.monotonic() + seconds
        while not fs.exists(p):
            if time.monotonic() > until:
                raise TimeoutError(f"no counters of batch {batch} in {self.table}")
            time.sleep(0.05)


def read_counters(spark: SparkSession, table: str) -> DataFrame:
    """counter, n and batch: rows, accepted, and how many rows break each rule."""
    return spark.read.schema("counter string, n long, batch long").option("basePath", table).json(f"{table}/batch=*")


def read_rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows that follow_rules() wrote, with `violations` and whether they are accepted."""
    return spark.read.parquet(f"{root}/rows").withColumn(ACCEPTED, F.col(ACCEPTED).cast("boolean"))


def judged(stream: DataFrame, rules: list[Rule], name: str) -> DataFrame:
    """stream with the violated rules of each row and whether it is accepted (it breaks no rule of action drop); counts are observed."""
    rows = with_violations(stream, rules)
    drop = F.array(*[F.lit(r.label) for r in rules if r.action == "drop"]).cast("array<string>")
    rows = rows.withColumn(ACCEPTED, ~F.arrays_overlap("violations", drop))
    broken = [F.count_if(F.array_contains("violations", r.label)).alias(r.label) for r in rules]
    return rows.observe(name, F.count("*").alias("rows"), F.count_if(F.col(ACCEPTED)).alias(ACCEPTED), *broken)


def follow_rules(stream: DataFrame, rules: list[Rule], root: str) -> StreamingQuery:
    """Take in all that the stream has now: rows go to root/rows by `accepted` in one write, counters to root/counters.

    Waits for the end; an error of the stream is raised, and the next call goes on from the checkpoint.
    """
    spark, name = stream.sparkSession, f"rules_{uuid.uuid4().hex}"
    counters = BatchCounters(spark, f"{root}/counters", name)
    spark.streams.addListener(counters)
    try:
        query = judged(stream, rules, name).writeStream.format("parquet").partitionBy(ACCEPTED).option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        done = [p.batchId for p in query.recentProgress if p.numInputRows]
        if done:
            counters.wait(done[-1])
        return query
    finally:
        spark.streams.removeListener(counters)

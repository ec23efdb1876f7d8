"""Queries over clustered files, deep pages, versions at many moments, and streams with windows and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from servista.functions.clean import RAW_FIELDS, stage
from servista.operators import history, layout, paging, quality
from servista.plans.adapter import REQUESTS_SQL as R, STAGED_SQL as S, VERSIONS_SQL as V, raw, requests, table, versions
from servista.plans.registry import query
from servista.plans.session import scratch
from servista.streaming import counters, windows


@query(f"WITH {R} SELECT 'ward' AS \"column\", CAST(ward AS VARCHAR) AS value, count(*) AS n, true AS skips FROM r GROUP BY ward UNION ALL SELECT 'sr_type', sr_type, count(*), true FROM r GROUP BY sr_type")
def clustered_requests(spark, sf_dir):
    """Rows of each ward and each type in files along a curve of both, and whether a filter on that column alone skips files."""
    path = scratch(spark, "clustered")
    columns = ["ward", "sr_type"]
    layout.write_clustered(requests(spark, sf_dir).select("sr_number", "status", *columns), path, columns, 16)
    rows = spark.read.parquet(path)
    ranges = layout.file_ranges(rows, columns)
    out = []
    for c in columns:
        read = layout.files_read(ranges, rows.select(c), c).select(F.col("value").alias(c), (F.col("files_read") < F.col("files")).alias("skips"))
        out.append(rows.groupBy(c).agg(F.count("*").alias("n")).join(read, c).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "n", "skips"))
    return out[0].union(out[1])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25 OFFSET (SELECT count(*) - 25 FROM lineitem)")
def last_page_of_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return paging.page(rows, [("l_extendedprice", False), ("l_orderkey", True), ("l_linenumber", True)], 25, rows.count() - 25, most=5_000)


@query(f"WITH {V}, m AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS moment FROM events) SELECT strftime(moment, '%Y-%m-%d') AS day, status, count(*) AS open FROM v JOIN m ON version_start <= moment AND (version_end IS NULL OR version_end > moment) GROUP BY 1, 2")
def open_versions_by_day(spark, sf_dir):
    """Versions that are valid at the start of each day that has events."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").cast("timestamp").alias("moment")).distinct()
    met = history.open_at(versions(spark, sf_dir), days, "moment")
    return met.groupBy(F.date_format("moment", "yyyy-MM-dd").alias("day"), "status").agg(F.count("*").alias("open"))


#: Events by their part of a stream: thirds of the time they span; of the first third every 50th comes with the third one, of the second
#: every 50th. What comes late by more than a tenth of the span, behind the latest row of the parts before, is dropped.
_PARTS = """e AS (SELECT event_id, ts, epoch_us(ts) AS u, (SELECT min(epoch_us(ts)) FROM events) AS low, (SELECT max(epoch_us(ts)) FROM events) AS high FROM events),
 p AS (SELECT ts, u, CASE WHEN event_id % 50 = 0 THEN 2 ELSE least(2, (u - low) * 3 // (high - low + 1)) END AS part, ((high - low) // 36000000) AS delay FROM e),
 d AS (SELECT *, date_trunc('hour', ts) AS hour, (SELECT max(u) FROM p q WHERE q.part < p.part) - delay * 1000000 AS mark FROM p)"""


@query(f"""WITH {_PARTS} SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM d WHERE (mark IS NULL OR epoch_us(hour) + 3600000000 > mark) AND epoch_us(hour) + 3600000000 <= (SELECT max(u) - any_value(delay) * 1000000 FROM p) GROUP BY 1""")
def ingestion_windows_of_a_stream(spark, sf_dir):
    """Events by hour from three runs of a stream with a watermark: late rows within it count, later ones are dropped, and hours are written once they are over."""
    root = scratch(spark, "windows")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    u = F.unix_micros("ts")
    span = events.agg(F.min(u).alias("low"), F.max(u).alias("high")).first()
    low, high = span["low"], span["high"]
    part = F.when(F.col("event_id") % 50 == 0, 2).otherwise(F.least(F.lit(2), F.floor((u - low) * 3 / (high - low + 1))))
    for k in range(3):
        events.filter(part == k).coalesce(1).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/landing")
        windows.follow_counts(windows.windowed_counts(stream, "ts", "1 hour", f"{(high - low) // 36_000_000} seconds"), f"{root}/hours", f"{root}/checkpoint").awaitTermination()
    hours = spark.read.parquet(f"{root}/hours")
    return hours.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


_STREAM_RULES = [quality.rule("not_null", "sr_number", action="drop"), quality.rule("one_of", "status", values=["OPEN", "COMPLETED", "CANCELED"], action="drop"), quality.rule("between", "ward", low=1, high=50)]
_BROKEN = {"not_null:sr_number": "sr_number IS NULL", "one_of:status": "status NOT IN ('OPEN', 'COMPLETED', 'CANCELED')", "between:ward": "ward NOT BETWEEN 1 AND 50"}
_GOOD = "sr_number IS NOT NULL AND (status IS NULL OR status IN ('OPEN', 'COMPLETED', 'CANCELED'))"


def _records_as_stream(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    rows = stage(raw(spark, sf_dir).select(*RAW_FIELDS, "_ingestion_timestamp", "_source_file"))
    rows.repartition(3).write.parquet(f"{root}/landing")
    return spark.readStream.schema(spark.read.parquet(f"{root}/landing").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")


@query(f"WITH {S} SELECT 'rows' AS counter, count(*) AS n, 3 AS batches FROM s UNION ALL SELECT 'accepted', count(*) FILTER ({_GOOD}), 3 FROM s" + "".join(f" UNION ALL SELECT '{k}', count(*) FILTER ({c}), 3 FROM s" for k, c in _BROKEN.items()))
def rule_counters_of_a_stream(spark, sf_dir):
    """What three batches of a stream counted, in one pass with writing accepted and quarantined rows."""
    root = scratch(spark, "counters")
    counters.follow_rules(_records_as_stream(spark, sf_dir, root), _STREAM_RULES, root)
    seen = counters.read_counters(spark, f"{root}/counters")
    return seen.groupBy("counter").agg(F.sum("n").alias("n"), F.countDistinct("batch").cast("int").alias("batches"))


@query(f"WITH {S} SELECT {_GOOD} AS accepted, count(*) AS n, count(*) FILTER (ward NOT BETWEEN 1 AND 50) AS odd_wards FROM s GROUP BY 1")
def accepted_and_quarantined_rows(spark, sf_dir):
    root = scratch(spark, "counters")
    counters.follow_rules(_records_as_stream(spark, sf_dir, root), _STREAM_RULES, root)
    rows = counters.read_rows(spark, root)
    return rows.groupBy("accepted").agg(F.count("*").alias("n"), F.count_if(F.array_contains("violations", "between:ward")).alias("odd_wards"))

"""Queries over sources, landing files, streams and kept tables: each runs the flow in a folder of its own and reads what it left."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from servista.functions.clean import RAW_FIELDS
from servista.operators import changes, quality
from servista.operators.history import END, START
from servista.plans import gold
from servista.plans.adapter import REQUESTS_SQL as R, VERSIONS_SQL as V, requests, table
from servista.plans.registry import query
from servista.plans.session import scratch
from servista.sources import catalog, landing, local_api, rest
from servista.streaming import bronze
from servista.streaming.history import HistoryTable
from servista.streaming.versions import VersionStream

#: The suppliers as records of an API: created on days from 2024-01-01 on, every other one changed thirty days later.
_SUPPLIERS = """a AS (SELECT CAST(s_suppkey AS VARCHAR) AS sr_number, s_name AS sr_type, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS created_date,
 CASE WHEN s_suppkey % 2 = 0 THEN strftime(TIMESTAMP '2024-01-31' + to_days(CAST(s_suppkey AS INTEGER)), '%Y-%m-%dT%H:%M:%S') END AS last_modified_date, CAST(s_nationkey AS VARCHAR) AS ward FROM supplier)"""


_SCHEMA = "sr_number string, sr_type string, created_date string, last_modified_date string, ward string"
_COLUMNS = "sr_number, sr_type, created_date, last_modified_date, ward"
_CHANGES = ("created_date", "last_modified_date")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda first, n: F.date_format(F.lit(first).cast("timestamp") + F.make_dt_interval(n), "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("s_suppkey").cast("int")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sr_number"), F.col("s_name").alias("sr_type"), day("2024-01-01", n).alias("created_date"), F.when(n % 2 == 0, day("2024-01-31", n)).alias("last_modified_date"), F.col("s_nationkey").cast("string").alias("ward"))


def _config(url: str) -> rest.ApiConfig:
    return rest.ApiConfig(url, page_size=30, pause=0.0, retry_backoff=0.01, window_days=100)


def _fetched(spark: SparkSession, sf_dir: str, read: Callable[[rest.ApiConfig], DataFrame]) -> DataFrame:
    """What `read` fetches from an API over the suppliers, of which every seventh request fails at first."""
    path = scratch(spark, "fetched")
    with local_api.serve(_records(spark, sf_dir), fails_every=7) as url:
        read(_config(url)).write.parquet(path)
    return spark.read.schema(_SCHEMA).parquet(path)


@query(f"WITH {_SUPPLIERS} SELECT {_COLUMNS} FROM a")
def api_all_pages(spark, sf_dir):
    return _fetched(spark, sf_dir, lambda c: rest.records(spark, c, schema=_SCHEMA))


@query(f"WITH {_SUPPLIERS} SELECT {_COLUMNS} FROM a WHERE created_date > '2024-01-20T00:00:00'")
def api_since(spark, sf_dir):
    return _fetched(spark, sf_dir, lambda c: rest.since(spark, c, "2024-01-20T00:00:00", _SCHEMA))


@query(f"WITH {_SUPPLIERS} SELECT {_COLUMNS} FROM a WHERE created_date >= '2024-01-05T00:00:00'")
def api_recent(spark, sf_dir):
    return _fetched(spark, sf_dir, lambda c: rest.recent(spark, c, 7, datetime(2024, 1, 12, 9), _SCHEMA))


@query(f"WITH {_SUPPLIERS} SELECT {_COLUMNS} FROM a WHERE created_date > '2024-02-10T00:00:00' OR last_modified_date > '2024-02-10T00:00:00'")
def api_changes_since(spark, sf_dir):
    return _fetched(spark, sf_dir, lambda c: rest.changes_since(spark, c, "2024-02-10T00:00:00", _CHANGES, _SCHEMA))


@query(f"WITH {_SUPPLIERS} SELECT {_COLUMNS} FROM a WHERE created_date >= '2024-01-03T00:00:00' AND created_date < '2024-01-08T00:00:00'")
def api_date_range(spark, sf_dir):
    return _fetched(spark, sf_dir, lambda c: rest.date_range(spark, c, "2024-01-03T00:00:00", "2024-01-08T00:00:00", _SCHEMA))


@query(f"WITH {_SUPPLIERS} SELECT {_COLUMNS} FROM a")
def api_with_fallback(spark, sf_dir):
    return _fetched(spark, sf_dir, lambda c: rest.with_fallback(spark, c, "created_date > '2999-01-01T00:00:00'", _SCHEMA))


@query(f"WITH {_SUPPLIERS} SELECT sr_number, created_date, ward, true AS has_file FROM a WHERE created_date >= '2024-01-04T00:00:00'")
def landing_initial_load(spark, sf_dir):
    folder = scratch(spark, "landing")
    with local_api.serve(_records(spark, sf_dir), fails_every=7) as url:
        for _ in range(2):  # a load that is begun again replaces what it landed
            landing.initial_load(spark, _config(url), folder, 1, datetime(2025, 1, 3), schema=_SCHEMA)
    rows = landing.read_landing(spark, folder)
    return rows.select("sr_number", "created_date", "ward", F.col("_source_file").contains("/initial/").alias("has_file"))


@query(f"""WITH {_SUPPLIERS}, f AS (SELECT * FROM a WHERE created_date >= '2024-01-02T00:00:00' AND created_date <= '2024-01-06T00:00:00'), m AS (SELECT max(greatest(created_date, coalesce(last_modified_date, created_date))) AS mark FROM f)
 SELECT sr_number, 'first' AS load FROM f UNION ALL SELECT sr_number, 'second' FROM a, m WHERE created_date > mark OR last_modified_date > mark""")
def landing_incremental_loads(spark, sf_dir):
    """Two runs of a stream over an API that has more to tell in the second one, and a third that finds nothing."""
    folder, root = scratch(spark, "landing"), scratch(spark, "state")
    rows = _records(spark, sf_dir)
    for served in (rows.filter("created_date <= '2024-01-06T00:00:00'"), rows, rows):
        with local_api.serve(served, fails_every=7) as url:
            landing.incremental_load(spark, _config(url), folder, f"{root}/checkpoint", "2024-01-02T00:00:00", _CHANGES, _SCHEMA).awaitTermination()
    return landing.read_landing(spark, folder).select("sr_number", F.when(F.col("_source_file").contains("batch000000"), "first").otherwise("second").alias("load"))


@query(f"WITH {_SUPPLIERS} SELECT sr_number, sr_type, ward FROM a WHERE ward IS NOT NULL")
def landing_preview(spark, sf_dir):
    folder = scratch(spark, "landing")
    landing.write_landing(_records(spark, sf_dir), folder)
    return landing.preview(spark, folder).select("sr_number", "sr_type", "ward")


def _orders_as_files(spark: SparkSession, sf_dir: str, folder: str, files: int = 3) -> None:
    """The orders as JSON files in the landing form."""
    named = {"sr_number": F.col("o_orderkey").cast("string"), "sr_type": F.col("o_orderpriority"), "status": F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "open"), "created_date": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")}
    rows = table(spark, sf_dir, "orders").select(*[named.get(c, F.lit(None)).cast("string").alias(c) for c in RAW_FIELDS])
    rows.repartition(files).write.json(f"{folder}/initial")


@query("SELECT 'bronze' AS layer, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders UNION ALL SELECT 'staged', count(*), count(DISTINCT o_orderkey) FROM orders WHERE o_orderstatus IN ('O', 'F')")
def bronze_and_staged_streams(spark, sf_dir):
    root = scratch(spark, "bronze")
    _orders_as_files(spark, sf_dir, f"{root}/landing")
    for _ in range(2):  # the second run finds nothing new
        tables = bronze.run_bronze(spark, f"{root}/landing", root)
    each = [spark.read.parquet(path).select(F.lit(layer).alias("layer"), "sr_number") for layer, path in zip(("bronze", "staged"), tables, strict=True)]
    return each[0].union(each[1]).groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("sr_number").alias("keys"))


@query("SELECT count(*) AS rows, 3 AS batches, true AS numbered FROM orders")
def bronze_batch_history(spark, sf_dir):
    root = scratch(spark, "bronze")
    _orders_as_files(spark, sf_dir, f"{root}/landing")
    bronze.append_batches(bronze.landing_stream(spark, f"{root}/landing", 1), f"{root}/bronze", f"{root}/checkpoint").awaitTermination()
    log = bronze.batch_history(spark, f"{root}/bronze")
    return log.agg(F.sum("rows").alias("rows"), F.count("*").cast("int").alias("batches"), (F.max("number") == 2).alias("numbered"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def ingestion_by_hour(spark, sf_dir):
    out = bronze.ingestion_counts(table(spark, sf_dir, "events").withColumnRenamed("ts", "_ingestion_timestamp"))
    return out.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {V} SELECT sr_number, status, value, is_info_call, version_start AS start_at, version_end AS end_at FROM v")
def history_kept_in_batches(spark, sf_dir):
    """The same history as in one go, from three batches of which the last has the earliest changes, and one comes twice."""
    feed = table(spark, sf_dir, "events").select(F.col("user_id").alias("sr_number"), "ts", F.col("event_type").alias("status"), "value", (F.col("event_type") == "view").alias("is_info_call"), "event_id")
    kept = HistoryTable(spark, scratch(spark, "history"), "sr_number", "ts", buckets=8, track=["status"], except_columns=("ts", "event_id"), tie=["event_id"])
    days = F.dayofmonth("ts")
    for number, part in ((0, days.between(11, 20)), (1, days > 20), (1, days > 20), (2, days < 11)):
        kept.add(feed.filter(part), number)
    return kept.read().withColumnsRenamed({START: "start_at", END: "end_at"})


def _version_stream(spark: SparkSession, sf_dir: str) -> VersionStream:
    """The events as two runs of a stream of files; most rows come late, as events are dealt to files by a hash of their id."""
    root = scratch(spark, "versions")
    feed = table(spark, sf_dir, "events").select(F.col("user_id").alias("sr_number"), "ts", F.col("event_type").alias("status"), "value", (F.col("event_type") == "view").alias("is_info_call"), "event_id")
    kept = VersionStream(spark, f"{root}/history", "sr_number", "ts", track=["status"], except_columns=("ts", "event_id"), tie=["event_id"])
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    for run in (0, 1):  # the second run starts from the first one's checkpoint
        feed.filter(half == run).repartition(2, "event_id").write.mode("append").parquet(f"{root}/landing")
        kept.follow(spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/landing")).awaitTermination()
    return kept


@query(f"WITH {V} SELECT sr_number, status, value, is_info_call, version_start AS start_at, version_end AS end_at FROM v")
def history_kept_by_state(spark, sf_dir):
    return _version_stream(spark, sf_dir).read().withColumnsRenamed({START: "start_at", END: "end_at"})


@query("SELECT user_id AS sr_number, count(DISTINCT ts) AS n FROM events GROUP BY user_id")
def history_state_sizes(spark, sf_dir):
    return _version_stream(spark, sf_dir).state_sizes()


@query(f"WITH {R}, g AS (SELECT date, ward, sr_type, is_info_call, count(*) AS total_requests FROM r GROUP BY date, ward, sr_type, is_info_call) SELECT CAST(date AS VARCHAR) AS date, count(*) AS groups, CAST(sum(total_requests) AS BIGINT) AS total FROM g GROUP BY g.date")
def gold_table_by_date(spark, sf_dir):
    path = scratch(spark, "gold")
    gold.write_gold(gold.daily_aggregates(requests(spark, sf_dir)), path, ["ward", "sr_type"])
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("groups"), F.sum("total_requests").alias("total"))


@query("""SELECT run, 'not_null:l_orderkey' AS rule, n AS checked, n AS good, true AS success FROM (SELECT count(*) AS n FROM lineitem), (SELECT unnest(['first', 'second']) AS run)
 UNION ALL SELECT run, 'between:l_quantity', n, g, g = n FROM (SELECT count(*) AS n, count(*) FILTER (l_quantity BETWEEN 1 AND 10) AS g FROM lineitem), (SELECT unnest(['first', 'second']) AS run)""")
def report_tables(spark, sf_dir):
    path = scratch(spark, "reports")
    rules = [quality.rule("between", "l_quantity", low=1, high=10), quality.rule("not_null", "l_orderkey")]
    for run in ("first", "second", "second"):  # a run that is repeated replaces itself
        quality.save_report(quality.evaluate(table(spark, sf_dir, "lineitem"), rules), path, run)
    return quality.read_reports(spark, path).select("run", "rule", "checked", "good", "success")


@query("SELECT r_regionkey, r_name FROM region")
def table_by_name(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("regions_by_name")
    out = catalog.table(spark, "regions_by_name").select("r_regionkey", "r_name")
    spark.catalog.dropTempView("regions_by_name")
    return out


@query("SELECT unnest(['checkpoints', 'incremental', 'initial']) AS name, true AS good")
def volume_folders(spark, sf_dir):
    v = catalog.Volume(spark, scratch(spark, "volumes"), "raw").create("initial", "incremental", "checkpoints")
    good = v.exists() and v.smoke_test()
    names = v.list()
    v.drop()
    return spark.createDataFrame([(n, good and not v.exists()) for n in names], "name string, good boolean")


@query("""SELECT folder, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'initial' ELSE 'incremental' END AS folder, o_custkey FROM orders) GROUP BY folder""")
def volume_contents(spark, sf_dir):
    """Orders put into two folders of a volume by date, and read back by folder; a third folder stays empty."""
    v = catalog.Volume(spark, scratch(spark, "volumes"), "raw").create("initial", "incremental", "checkpoints")
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_custkey")
    first = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    for folder, rows in (("initial", orders.filter(first)), ("incremental", orders.filter(~first))):
        rows.write.mode("append").parquet(f"{v.path}/{folder}")
    each = [spark.read.parquet(f"{v.path}/{folder}").withColumn("folder", F.lit(folder)) for folder in v.list() if v.list(folder)]
    return each[0].unionByName(each[1]).groupBy("folder").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT 'raw.orders' AS name, count(*) AS n, 'Landing files' AS comment FROM orders UNION ALL SELECT 'gold.orders_by_status', count(DISTINCT o_orderstatus), 'Aggregates' FROM orders")
def tables_of_layers(spark, sf_dir):
    """Databases of the layers, a table of orders in one and an aggregate of it, read by its name, in another."""
    prefix, path = "servista_q_", scratch(spark, "layers")
    names = catalog.create_layers(spark, prefix, reset=True)
    try:
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.option("path", f"{path}/orders").saveAsTable(f"{prefix}raw.orders")
        catalog.table(spark, f"{prefix}raw.orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).write.option("path", f"{path}/by_status").saveAsTable(f"{prefix}gold.orders_by_status")
        counts = catalog.table(spark, f"{prefix}raw.orders").agg(F.count("*").alias("n")).select(F.lit("raw").alias("layer"), F.lit("orders").alias("table"), "n")
        counts = counts.union(catalog.table(spark, f"{prefix}gold.orders_by_status").agg(F.count("*").alias("n")).select(F.lit("gold"), F.lit("orders_by_status"), "n"))
        comments = catalog.describe_layers(spark, names).filter("tables = 1").select(F.substring("name", len(prefix) + 1, 99).alias("layer"), "comment")
        out = counts.join(comments, "layer").select(F.concat_ws(".", "layer", "table").alias("name"), "n", "comment")
        out.write.parquet(f"{path}/out")
    finally:
        catalog.drop_layers(spark, prefix)
    return spark.read.parquet(f"{path}/out")


@query(f"WITH {R} SELECT sr_number, created_date FROM r WHERE created_date > TIMESTAMP '2001-01-01'")
def since(spark, sf_dir):
    return changes.since(requests(spark, sf_dir), "created_date", F.lit("2001-01-01").cast("timestamp")).select("sr_number", "created_date")

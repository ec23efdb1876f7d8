"""Star-schema tables seen as service requests and as a change history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from servista.functions.clean import INFO_CALL, RAW_FIELDS
from servista.functions.dates import hours_between
from servista.operators.history import apply_changes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as current requests: wards are nations, types are priorities, departments are market segments.

    A request that isn't open closes with its last shipment, if that is not before its creation.
    """
    orders, customer, lines = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    shipped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(shipped, "o_orderkey", "left")
    open_ = F.col("o_orderstatus") == "O"
    closed = F.when(~open_ & (F.col("shipped") >= F.col("o_orderdate")), F.col("shipped"))
    return rows.select(
        F.col("o_orderkey").alias("sr_number"),
        F.col("o_orderdate").alias("created_date"),
        closed.alias("closed_date"),
        F.col("o_orderpriority").alias("sr_type"),
        F.col("c_mktsegment").alias("owner_department"),
        F.when(open_, "OPEN").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("CANCELED").alias("status"),
        (F.col("c_nationkey") + 1).alias("ward"),
        F.when(F.col("o_orderkey") % 3 == 0, "PHONE").when(F.col("o_orderkey") % 3 == 1, "WEB").otherwise("APP").alias("origin"),
        F.col("o_orderpriority").startswith("5").alias("is_info_call"),
        hours_between(F.col("o_orderdate"), closed).alias("resolution_hours"),
    )


#: The request view in DuckDB's SQL, as r.
REQUESTS_SQL = """shipped AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
r AS (SELECT *, date_sub('hour', created_date, closed_date) AS resolution_hours, CAST(created_date AS DATE) AS date FROM (
  SELECT o_orderkey AS sr_number, o_orderdate AS created_date,
    CASE WHEN o_orderstatus <> 'O' AND shipped >= o_orderdate THEN shipped END AS closed_date,
    o_orderpriority AS sr_type, c_mktsegment AS owner_department,
    CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'COMPLETED' ELSE 'CANCELED' END AS status,
    CAST(c_nationkey + 1 AS INTEGER) AS ward,
    CASE o_orderkey % 3 WHEN 0 THEN 'PHONE' WHEN 1 THEN 'WEB' ELSE 'APP' END AS origin,
    o_orderpriority LIKE '5%' AS is_info_call
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN shipped ON l_orderkey = o_orderkey))"""


def versions(spark: SparkSession, sf_dir: str, track: tuple[str, ...] | None = ("status",)) -> DataFrame:
    """Events as the history of their users: the status is the event's type."""
    feed = table(spark, sf_dir, "events").select(F.col("user_id").alias("sr_number"), "ts", F.col("event_type").alias("status"), "value", (F.col("event_type") == "view").alias("is_info_call"), "event_id")
    return apply_changes(feed, "sr_number", "ts", track=list(track) if track else None, except_columns=("ts", "event_id"), tie=["event_id"])


#: The versions in DuckDB's SQL, as v.
VERSIONS_SQL = """v AS (SELECT sr_number, status, value, is_info_call, ts AS version_start, lead(ts) OVER (PARTITION BY sr_number ORDER BY ts) AS version_end FROM (
  SELECT user_id AS sr_number, event_type AS status, value, event_type = 'view' AS is_info_call, ts,
    lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR before <> status)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as landed records: all fields strings, with the faults that standardisation and rules are there for, dealt by key."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = lambda moment: F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fields = {
        "sr_number": F.when(k % 97 == 0, None).when(k % 53 == 0, "").when(k % 59 == 0, "SR0").otherwise(F.concat(F.lit("SR"), k.cast("string"))),
        "sr_type": F.when(k % 11 == 0, None).when(k % 5 == 0, INFO_CALL + " ").when(k % 5 == 1, INFO_CALL).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))),
        "status": F.when(k % 13 == 0, None).when(k % 17 == 0, "In Progress").when(F.col("o_orderstatus") == "O", " open ").when(F.col("o_orderstatus") == "F", "Completed").otherwise("CANCELED"),
        "created_date": F.when(k % 19 == 0, "not a time").when(k % 23 == 0, None).otherwise(text(day)),
        "closed_date": F.when(F.col("o_orderstatus") == "F", text(day + F.expr("INTERVAL 30 HOURS"))),
        "last_modified_date": F.when(k % 3 == 0, text(day + F.expr("INTERVAL 2 DAYS"))),
        "ward": F.when(k % 29 == 0, "abc").when(k % 31 == 0, "28.0").when(k % 37 == 0, "").otherwise((k % 52).cast("string")),
        "latitude": F.when(k % 7 != 0, F.concat(F.lit("41."), F.lpad((k % 100).cast("string"), 2, "0"))),
        "longitude": F.concat(F.lit("-87."), F.lpad((k % 90).cast("string"), 2, "0")),
        "origin": F.lit(" web "),
        "duplicate": F.when(k % 7 == 0, "true").when(k % 7 == 1, "no idea"),
    }
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[fields.get(c, F.lit(None)).cast("string").alias(c) for c in RAW_FIELDS])
    return rows.withColumns({"_ingestion_timestamp": F.lit("2024-03-01").cast("timestamp"), "_source_file": F.lit("orders")})


#: The landed records in DuckDB's SQL, as w; and standardised, as s.
RAW_SQL = """w AS (SELECT o_orderkey AS k,
  CASE WHEN k % 97 = 0 THEN NULL WHEN k % 53 = 0 THEN '' WHEN k % 59 = 0 THEN 'SR0' ELSE 'SR' || k END AS sr_number,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 5 = 0 THEN '311 INFORMATION ONLY CALL ' WHEN k % 5 = 1 THEN '311 INFORMATION ONLY CALL' ELSE ' ' || o_orderpriority || ' ' END AS sr_type,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'In Progress' WHEN o_orderstatus = 'O' THEN ' open ' WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'CANCELED' END AS status,
  CASE WHEN k % 19 = 0 THEN 'not a time' WHEN k % 23 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS created_date,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 30 HOUR, '%Y-%m-%dT%H:%M:%S') END AS closed_date,
  CASE WHEN k % 3 = 0 THEN strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%S') END AS last_modified_date,
  CASE WHEN k % 29 = 0 THEN 'abc' WHEN k % 31 = 0 THEN '28.0' WHEN k % 37 = 0 THEN '' ELSE CAST(k % 52 AS VARCHAR) END AS ward,
  CASE WHEN k % 7 <> 0 THEN '41.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') END AS latitude,
  '-87.' || lpad(CAST(k % 90 AS VARCHAR), 2, '0') AS longitude,
  CASE WHEN k % 7 = 0 THEN 'true' WHEN k % 7 = 1 THEN 'no idea' END AS duplicate FROM orders)"""
STAGED_SQL = f"""{RAW_SQL}, s AS (SELECT k, sr_number, trim(sr_type) AS sr_type, upper(trim(status)) AS status, TRY_CAST(created_date AS TIMESTAMP) AS created, TRY_CAST(closed_date AS TIMESTAMP) AS closed,
  CASE WHEN regexp_full_match(ward, '[0-9]+') THEN CAST(ward AS INTEGER) END AS ward, CAST(latitude AS DOUBLE) BETWEEN 41.6 AND 42.1 AND CAST(longitude AS DOUBLE) BETWEEN -87.95 AND -87.5 AS inside,
  CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon, TRY_CAST(last_modified_date AS TIMESTAMP) AS modified, CASE duplicate WHEN 'true' THEN true END AS is_duplicate FROM w)"""
#: Rows of s that meet the constraints.
VALID_SQL = "sr_number IS NOT NULL AND created IS NOT NULL AND sr_type IS NOT NULL AND status IN ('OPEN', 'COMPLETED', 'CANCELED')"

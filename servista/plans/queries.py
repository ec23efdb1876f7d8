"""The engine's queries over the star-schema tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from servista.functions.dates import fractional_hours
from servista.operators import changes, history, profile, quality, selection
from servista.operators.history import END, START
from servista.plans import forecast, gold, monitor, suites
from servista.plans.adapter import REQUESTS_SQL as R, VERSIONS_SQL as V, requests, table, versions
from servista.plans.registry import query

NOW = "2024-03-01 00:00:00"
_CAL = "CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month"
_WEEKEND = "CAST(dayofweek(date) IN (0, 6) AS INTEGER) AS is_weekend"


def _now():
    return F.lit(NOW).cast("timestamp")


def _days(df: DataFrame, column: str = "date") -> DataFrame:
    """Dates as text, so that both engines hash them alike."""
    return df.withColumn(column, F.col(column).cast("string"))


_DATE = "CAST(date AS VARCHAR) AS date"


@query(f"""WITH {R} SELECT {_DATE}, ward, sr_type, is_info_call, count(*) AS total_requests,
 count(*) FILTER (status = 'COMPLETED') AS completed_count, count(*) FILTER (status = 'OPEN') AS open_count, count(*) FILTER (status = 'CANCELED') AS canceled_count,
 avg(resolution_hours) AS avg_resolution_hours, quantile_disc(resolution_hours, 0.5) AS median_resolution_hours,
 CAST(count(*) FILTER (status = 'COMPLETED') AS DOUBLE) / count(*) AS completion_rate,
 count(*) FILTER (origin = 'PHONE') AS phone_requests, count(*) FILTER (origin = 'WEB') AS web_requests, count(*) FILTER (origin = 'APP') AS app_requests,
 {_CAL}, {_WEEKEND} FROM r GROUP BY r.date, ward, sr_type, is_info_call""")
def daily_aggregates(spark, sf_dir):
    return _days(gold.daily_aggregates(requests(spark, sf_dir)))


@query(f"""WITH {R}, d AS (SELECT date, ward, count(*) AS total_requests, count(*) FILTER (NOT is_info_call) AS service_requests, count(*) FILTER (is_info_call) AS info_calls,
 count(DISTINCT sr_type) AS unique_sr_types, avg(resolution_hours) AS avg_resolution_hours, CAST(count(*) FILTER (status = 'COMPLETED') AS DOUBLE) / count(*) AS completion_rate FROM r GROUP BY date, ward)
SELECT {_DATE}, ward, total_requests, service_requests, info_calls, unique_sr_types, avg_resolution_hours, completion_rate,
 lag(total_requests, 1) OVER w AS requests_1d_ago, lag(total_requests, 7) OVER w AS requests_7d_ago, lag(total_requests, 28) OVER w AS requests_28d_ago,
 avg(total_requests) OVER (PARTITION BY ward ORDER BY d.date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS rolling_7d_avg,
 avg(total_requests) OVER (PARTITION BY ward ORDER BY d.date ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING) AS rolling_28d_avg, {_CAL}, {_WEEKEND}
FROM d WINDOW w AS (PARTITION BY ward ORDER BY d.date)""")
def ward_daily_summary(spark, sf_dir):
    return _days(gold.ward_daily_summary(requests(spark, sf_dir)))


@query(f"""WITH {R}, d AS (SELECT date, count(*) AS total_requests, count(*) FILTER (NOT is_info_call) AS service_requests, count(*) FILTER (is_info_call) AS info_calls,
 count(DISTINCT sr_type) AS unique_sr_types, count(DISTINCT ward) AS wards_with_requests, avg(resolution_hours) AS avg_resolution_hours,
 avg(CASE WHEN resolution_hours > 0.1 THEN resolution_hours END) AS avg_resolution_hours_excl_instant, CAST(count(*) FILTER (status = 'COMPLETED') AS DOUBLE) / count(*) AS completion_rate FROM r GROUP BY date),
l AS (SELECT *, lag(service_requests, 1) OVER w AS requests_1d_ago, lag(service_requests, 7) OVER w AS requests_7d_ago, lag(service_requests, 28) OVER w AS requests_28d_ago, lag(service_requests, 365) OVER w AS requests_1y_ago,
 avg(service_requests) OVER (ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS rolling_7d_avg, avg(service_requests) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING) AS rolling_28d_avg FROM d WINDOW w AS (ORDER BY date))
SELECT CAST(date AS VARCHAR) AS ds, service_requests AS y, {_DATE}, total_requests, service_requests, info_calls, unique_sr_types, wards_with_requests, avg_resolution_hours, avg_resolution_hours_excl_instant, completion_rate,
 requests_1d_ago, requests_7d_ago, requests_28d_ago, requests_1y_ago, rolling_7d_avg, rolling_28d_avg,
 CASE WHEN requests_1y_ago > 0 THEN CAST(service_requests - requests_1y_ago AS DOUBLE) / requests_1y_ago END AS yoy_change,
 {_CAL}, CAST(dayofyear(l.date) AS INTEGER) AS day_of_year, CAST(weekofyear(l.date) AS INTEGER) AS week_of_year, {_WEEKEND}, service_requests > 10 AS is_anomaly_service, total_requests > 12 AS is_anomaly_total FROM l""")
def citywide_daily_summary(spark, sf_dir):
    return _days(_days(gold.citywide_daily_summary(requests(spark, sf_dir), service_limit=10, total_limit=12)), "ds")


@query(f"""WITH {R} SELECT owner_department, {_DATE}, count(*) AS total_requests, count(*) FILTER (NOT is_info_call) AS service_requests, count(DISTINCT sr_type) AS sr_types_handled,
 count(*) FILTER (status = 'COMPLETED') AS completed_count, CAST(count(*) FILTER (status = 'COMPLETED') AS DOUBLE) / count(*) AS completion_rate, avg(resolution_hours) AS avg_resolution_hours,
 quantile_disc(resolution_hours, 0.5) AS median_resolution_hours, quantile_disc(resolution_hours, 0.9) AS p90_resolution_hours FROM r GROUP BY owner_department, r.date""")
def department_performance(spark, sf_dir):
    return _days(gold.department_performance(requests(spark, sf_dir)))


@query(f"""WITH {R}, m AS (SELECT date, sr_type, is_info_call, ward, row_number() OVER (PARTITION BY date, sr_type, is_info_call ORDER BY count(*) DESC, ward) AS nth FROM r GROUP BY date, sr_type, is_info_call, ward)
SELECT CAST(r.date AS VARCHAR) AS date, r.sr_type, r.is_info_call, count(*) AS total_requests, count(*) FILTER (status = 'COMPLETED') AS completed_count,
 CAST(count(*) FILTER (status = 'COMPLETED') AS DOUBLE) / count(*) AS completion_rate, avg(resolution_hours) AS avg_resolution_hours, any_value(m.ward) AS most_common_ward, count(DISTINCT r.ward) AS wards_affected
FROM r JOIN m ON r.date = m.date AND r.sr_type = m.sr_type AND r.is_info_call = m.is_info_call AND nth = 1 GROUP BY r.date, r.sr_type, r.is_info_call""")
def request_type_summary(spark, sf_dir):
    return _days(gold.request_type_summary(requests(spark, sf_dir)))


_STATUS = f"{V}, h AS (SELECT *, date_sub('hour', version_start, coalesce(version_end, TIMESTAMP '{NOW}')) AS hours_in_status, row_number() OVER (PARTITION BY sr_number ORDER BY version_start) AS version_number, version_end IS NULL AS is_current FROM v)"


def _status(spark, sf_dir):
    return history.status_history(versions(spark, sf_dir), "sr_number", _now(), ["status", "is_info_call"])


@query(f"""WITH {_STATUS}, n AS (SELECT *, lead(status) OVER (PARTITION BY sr_number ORDER BY version_start) AS next_status FROM h)
SELECT status AS from_status, next_status AS to_status, is_info_call, count(*) AS transition_count, avg(hours_in_status) AS avg_hours_before_transition, quantile_disc(hours_in_status, 0.5) AS median_hours_before_transition,
 avg(CASE WHEN hours_in_status > 0.1 THEN hours_in_status END) AS avg_hours_excl_instant, min(hours_in_status) AS min_hours, max(hours_in_status) AS max_hours FROM n WHERE next_status IS NOT NULL GROUP BY status, next_status, is_info_call""")
def status_transitions(spark, sf_dir):
    return history.transitions(_status(spark, sf_dir), "sr_number", ["is_info_call"])


@query(f"WITH {V} SELECT sr_number, status, value, is_info_call, version_start AS start_at, version_end AS end_at FROM v")
def scd2_history(spark, sf_dir):
    return versions(spark, sf_dir).withColumnsRenamed({START: "start_at", END: "end_at"})


@query(f"WITH {V} SELECT sr_number, status, value, is_info_call, version_start AS start_at FROM v WHERE version_end IS NULL")
def scd2_current(spark, sf_dir):
    return history.current(versions(spark, sf_dir)).withColumnRenamed(START, "start_at").drop(END)


@query("""SELECT user_id AS sr_number, event_type AS status, value, ts AS start_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS end_at FROM
 (SELECT *, lag(event_type) OVER w AS b1, lag(value) OVER w AS b2, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE nth = 1 OR b1 IS DISTINCT FROM event_type OR b2 IS DISTINCT FROM value""")
def scd2_history_all_columns(spark, sf_dir):
    return versions(spark, sf_dir, track=None).withColumnsRenamed({START: "start_at", END: "end_at"}).drop("is_info_call")


@query(f"WITH {_STATUS} SELECT sr_number, status, is_info_call, version_start, version_end, hours_in_status, CAST(version_number AS INTEGER) AS version_number, is_current FROM h")
def status_history(spark, sf_dir):
    return _status(spark, sf_dir)


@query(f"WITH {V} SELECT sr_number, status, version_start AS start_at, version_end AS end_at FROM v WHERE version_start <= TIMESTAMP '2024-01-15 12:00:00' AND (version_end IS NULL OR version_end > TIMESTAMP '2024-01-15 12:00:00')")
def point_in_time(spark, sf_dir):
    return history.as_of(versions(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp")).select("sr_number", "status", F.col(START).alias("start_at"), F.col(END).alias("end_at"))


@query(f"WITH {_STATUS} SELECT status, count(*) AS versions, avg(hours_in_status) AS avg_hours FROM h GROUP BY status")
def time_in_status(spark, sf_dir):
    return history.time_in_status(_status(spark, sf_dir))


@query(f"WITH {V} SELECT status, version_start AS start_at, version_end AS end_at FROM v WHERE sr_number = 7 ORDER BY version_start")
def request_history(spark, sf_dir):
    return history.request_history(versions(spark, sf_dir), "sr_number", 7).select("status", F.col(START).alias("start_at"), F.col(END).alias("end_at"))


@query("SELECT event_id, user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS nth FROM events) WHERE nth = 1")
def latest_per_key(spark, sf_dir):
    return changes.latest_per_key(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"), "user_id", "ts")


_SINCE = "TIMESTAMP '2000-01-01 00:00:00'"


@query(f"WITH {R} SELECT sr_number, status, created_date, closed_date FROM r WHERE created_date > {_SINCE} OR closed_date > {_SINCE}")
def changes_since(spark, sf_dir):
    return changes.changed_since(requests(spark, sf_dir), ["created_date", "closed_date"], F.lit("2000-01-01").cast("timestamp")).select("sr_number", "status", "created_date", "closed_date")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01'")
def date_range(spark, sf_dir):
    a, b = (F.lit(x).cast("timestamp") for x in ("1998-01-01", "1998-02-01"))
    return changes.date_range(table(spark, sf_dir, "orders"), "o_orderdate", a, b).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '2001-08-01' - 7")
def recent(spark, sf_dir):
    return changes.recent(table(spark, sf_dir, "orders"), "o_orderdate", 7, F.lit("2001-08-01").cast("date")).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    return changes.page(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 20, 40).select("o_orderkey", "o_orderdate")


@query(f"""WITH {V} SELECT count(DISTINCT sr_number) AS total_unique_requests, count(*) AS total_versions, count(*) FILTER (version_end IS NULL) AS current_versions, count(*) FILTER (version_end IS NOT NULL) AS historical_versions,
 max(version_start) AS latest_version_start, round(count(*)::DOUBLE / count(DISTINCT sr_number), 2) AS avg_versions_per_request, CASE WHEN round(count(*)::DOUBLE / count(DISTINCT sr_number), 2) BETWEEN 1.0 AND 2.0 THEN 'HEALTHY' ELSE 'INVESTIGATE' END AS version_rate_status FROM v""")
def version_stats(spark, sf_dir):
    return monitor.version_stats(versions(spark, sf_dir))


@query(f"""WITH {V} SELECT 'raw' AS layer, max(ts) AS latest_record, count(*) AS total_records, date_sub('hour', max(ts), TIMESTAMP '{NOW}') AS hours_since_update FROM events
 UNION ALL SELECT 'history', max(version_start), count(*), date_sub('hour', max(version_start), TIMESTAMP '{NOW}') FROM v""")
def freshness(spark, sf_dir):
    return monitor.freshness({"raw": (table(spark, sf_dir, "events"), "ts"), "history": (versions(spark, sf_dir), START)}, _now())


@query(f"""WITH {R} SELECT {_DATE}, count(*) AS total_requests, count(*) FILTER (is_info_call) AS info_calls, round(count(*) FILTER (is_info_call)::DOUBLE / count(*) * 100, 1) AS info_call_pct,
 CASE WHEN count(*) FILTER (is_info_call)::DOUBLE / count(*) BETWEEN 0.35 AND 0.45 THEN 'NORMAL' ELSE 'INVESTIGATE' END AS ratio_status FROM r GROUP BY r.date ORDER BY r.date DESC LIMIT 30""")
def info_ratio(spark, sf_dir):
    return _days(monitor.info_call_ratio(requests(spark, sf_dir)))


@query(f'WITH {R} SELECT status, count(*) AS "count", round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM r GROUP BY status ORDER BY 2 DESC')
def status_distribution(spark, sf_dir):
    return monitor.status_distribution(requests(spark, sf_dir)).withColumn("pct", F.col("pct").cast("double"))


@query(f"""WITH {R} SELECT c AS "column", count(*) AS n_rows, count(x) AS n_values, count(DISTINCT x) AS n_distinct, min(x) AS sample, 1 - count(x)::DOUBLE / count(*) AS null_rate,
 CASE WHEN 1 - count(x)::DOUBLE / count(*) < 0.01 THEN 'critical' WHEN 1 - count(x)::DOUBLE / count(*) < 0.05 THEN 'required' WHEN 1 - count(x)::DOUBLE / count(*) < 0.10 THEN 'mostly' WHEN 1 - count(x)::DOUBLE / count(*) < 0.15 THEN 'optional' ELSE 'nullable' END AS recommendation
 FROM (SELECT unnest(['status', 'ward', 'closed_date']) AS c, unnest([status, lpad(ward::VARCHAR, 2, '0'), closed_date::VARCHAR]) AS x FROM r) GROUP BY c""")
def profile_nulls(spark, sf_dir):
    return profile.null_profile(requests(spark, sf_dir).select("status", F.lpad(F.col("ward").cast("string"), 2, "0").alias("ward"), "closed_date"))


@query(f"WITH {R} SELECT sr_type AS value, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM r GROUP BY sr_type")
def value_counts(spark, sf_dir):
    return profile.value_counts(requests(spark, sf_dir), "sr_type").withColumn("pct", F.col("pct").cast("double"))


_WORDS = "(SELECT unnest(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+')) AS value FROM documents)"


@query(f"""SELECT value, n, n * 100.0 / (SELECT count(*) FROM {_WORDS}) AS pct FROM (SELECT value, count(*) AS n FROM {_WORDS} GROUP BY value ORDER BY n DESC, value LIMIT 50)""")
def top_words(spark, sf_dir):
    """The most frequent words of all documents, exactly, without a shuffle of all words."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0B\f]+"), 0))
    return profile.value_counts(table(spark, sf_dir, "documents").select(words.alias("value")), "value", 50).withColumn("pct", F.col("pct").cast("double"))


@query("SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.01) AS p1, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.999) AS p999, count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def price_quantiles(spark, sf_dir):
    return selection.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"p1": 0.01, "p50": 0.5, "p999": 0.999}, ["l_returnflag", "l_linestatus"], held=0).drop("mean")


#: Columns of lineitem whose uniqueness is asked for, alone and together.
_UNIQUE = [["l_orderkey"], ["l_partkey"], ["l_suppkey"], ["l_extendedprice"], ["l_shipdate"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey"], ["l_partkey", "l_suppkey"], ["l_partkey", "l_shipdate"], ["l_suppkey", "l_extendedprice", "l_quantity"]]


@query(" UNION ALL ".join(f"SELECT '{','.join(c)}' AS \"column\", CAST(coalesce(sum(n), 0) AS BIGINT) AS checked, count(*) FILTER (n = 1) AS good, count(*) FILTER (n = 1) >= 0.5 * sum(n) AS success FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(c)})" for c in _UNIQUE))
def uniqueness_of_ten_keys(spark, sf_dir):
    rules = [quality.rule("unique" if len(c) == 1 else "unique_combination", *c, mostly=0.5) for c in _UNIQUE]
    return quality.evaluate(table(spark, sf_dir, "lineitem"), rules).select("column", "checked", "good", "success")


@query(f"WITH {R} SELECT ward, quantile_cont(resolution_hours, 0.25) AS p25, quantile_cont(resolution_hours, 0.5) AS p50, quantile_cont(resolution_hours, 0.75) AS p75, quantile_cont(resolution_hours, 0.95) AS p95, avg(resolution_hours) AS mean FROM r GROUP BY ward")
def quantiles(spark, sf_dir):
    return profile.quantiles(requests(spark, sf_dir), "resolution_hours", ["ward"])


@query(f"""WITH {R}, d AS (SELECT date, count(*) AS n FROM r GROUP BY date) SELECT round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS least, max(n) AS most, round(stddev_samp(n) / avg(n), 6) AS variation, round(avg(n) + 2 * stddev_samp(n), 6) AS threshold FROM d""")
def daily_stats(spark, sf_dir):
    out = profile.daily_stats(requests(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if c not in ("least", "most") else F.col(c) for c in out.columns])


@query(f"""WITH {R}, d AS (SELECT date, count(*) AS n FROM r GROUP BY date), m AS (SELECT avg(n) FILTER (dayofweek(date) NOT IN (0, 6)) AS weekday_mean, avg(n) FILTER (dayofweek(date) IN (0, 6)) AS weekend_mean FROM d)
 SELECT weekday_mean, weekend_mean, (1 - weekend_mean / weekday_mean) * 100 AS drop_pct, weekend_mean / weekday_mean AS weekend_factor FROM m""")
def weekend_drop(spark, sf_dir):
    return profile.weekend_drop(requests(spark, sf_dir))


@query(f"WITH {R} SELECT CAST(isodow(created_date) - 1 AS INTEGER) AS day_number, dayname(created_date) AS day_name, count(*) AS n FROM r GROUP BY 1, 2")
def by_weekday(spark, sf_dir):
    return profile.by_weekday(requests(spark, sf_dir))


@query(f"""WITH {R} SELECT bin, CAST(bin AS DOUBLE) * 33.6 AS edge, count(*) AS n FROM (SELECT CAST(least(floor(resolution_hours / 33.6), 49) AS INTEGER) AS bin FROM r WHERE resolution_hours BETWEEN 0 AND 1680) GROUP BY bin""")
def histogram(spark, sf_dir):
    return profile.histogram(requests(spark, sf_dir), "resolution_hours", 0.0, 1680.0)


@query("SELECT count(*) AS total, count(DISTINCT l_orderkey) AS \"unique\", (count(*) - count(DISTINCT l_orderkey))::DOUBLE / count(*) * 100 AS duplicate_pct FROM lineitem")
def duplicate_report(spark, sf_dir):
    return profile.duplicate_report(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"""WITH {R}, d AS (SELECT date, count(*) AS n FROM r GROUP BY date), t AS (SELECT avg(n) + 2 * stddev_samp(n) AS threshold FROM d)
 SELECT CAST(date AS VARCHAR) AS date, n, round(threshold, 6) AS threshold, n > threshold AS is_anomaly, CASE WHEN n > threshold THEN round((n - threshold) / threshold, 6) END AS anomaly_score FROM d, t""")
def threshold_anomalies(spark, sf_dir):
    daily = requests(spark, sf_dir).groupBy(F.to_date("created_date").alias("date")).agg(F.count("*").alias("n"))
    out = profile.anomalies(daily, "n")
    return _days(out.withColumn("threshold", F.round("threshold", 6)).withColumn("anomaly_score", F.round("anomaly_score", 6)))


@query(f"""WITH {R}, t AS (SELECT ward FROM r GROUP BY ward ORDER BY count(*) DESC, ward LIMIT 5) SELECT {_DATE}, ward, count(*) AS n FROM r WHERE ward IN (SELECT ward FROM t) GROUP BY r.date, ward""")
def top_wards_daily(spark, sf_dir):
    return _days(profile.top_groups_daily(requests(spark, sf_dir), "ward", 5))


@query("SELECT DISTINCT p_name FROM part WHERE p_size < 10 EXCEPT SELECT p_name FROM part WHERE NOT p_size < 10")
def type_set_difference(spark, sf_dir):
    return profile.only_in(table(spark, sf_dir, "part"), "p_name", F.col("p_size") < 10)


@query(f"WITH {R} SELECT ward, count(sr_number) AS requests, count(*) FILTER (status = 'COMPLETED')::DOUBLE / count(*) AS completed_share, avg(resolution_hours) AS mean_resolution_hours FROM r GROUP BY ward")
def ward_summary_join(spark, sf_dir):
    return profile.ward_summary_with_resolution(requests(spark, sf_dir))


@query(f"""WITH {R}, f AS (SELECT count(*)::VARCHAR a, count(DISTINCT sr_number)::VARCHAR b, min(date)::VARCHAR c, max(date)::VARCHAR d, count(DISTINCT sr_type)::VARCHAR e, count(DISTINCT ward)::VARCHAR f, count(DISTINCT owner_department)::VARCHAR g,
  count(*) FILTER (status = 'COMPLETED')::VARCHAR h, count(*) FILTER (status = 'OPEN')::VARCHAR i, count(*) FILTER (is_info_call)::VARCHAR j, round(avg(is_info_call::INTEGER) * 100, 2)::VARCHAR k FROM r)
 SELECT unnest(['total_requests', 'unique_requests', 'first_day', 'last_day', 'request_types', 'wards', 'departments', 'completed', 'open', 'info_calls', 'info_call_pct']) AS metric, unnest([a, b, c, d, e, f, g, h, i, j, k]) AS value FROM f""")
def exploration_summary(spark, sf_dir):
    return profile.metrics(requests(spark, sf_dir))


@query(f"""WITH {R} SELECT {_DATE}, CAST(hour(created_date) AS INTEGER) AS hour, count(*) AS n, round(avg(date_diff('microsecond', created_date, closed_date) / 3600000000.0), 6) AS mean_hours FROM r GROUP BY r.date, hour(created_date) ORDER BY r.date DESC, 2 LIMIT 10""")
def hourly_counts(spark, sf_dir):
    rows = requests(spark, sf_dir)
    out = rows.groupBy(F.to_date("created_date").alias("date"), F.hour("created_date").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg(fractional_hours(F.col("created_date"), F.col("closed_date"))), 6).alias("mean_hours"))
    return _days(out.orderBy(F.desc("date"), "hour").limit(10))


def _silver_results(spark, sf_dir):
    key = F.col("sr_number")
    rows = requests(spark, sf_dir).withColumn("latitude", F.when(key % 9 != 0, 41 + (key % 100) / 100)).withColumn("longitude", -87 - (key % 100) / 100)
    return quality.evaluate(rows, suites.SILVER)


def _gold_results(spark, sf_dir):
    return quality.evaluate(gold.daily_aggregates(requests(spark, sf_dir)), suites.GOLD)


def _checks(layer: str, items: list[tuple[str, str, str, str, str]], source: str) -> str:
    """One SELECT a check: kind, column, action, checked and good as SQL over the source."""
    return " UNION ALL ".join(f"SELECT '{layer}' AS layer, '{kind}:{column}' AS rule, '{kind}' AS kind, '{column}' AS \"column\", '{action}' AS action, CAST({checked} AS BIGINT) AS checked, CAST({good} AS BIGINT) AS good, coalesce({good} / nullif({checked}, 0), 1) >= {mostly} AS success FROM {source}" for kind, column, action, checked, good, mostly in items)


def _silver_sql() -> str:
    n = "count(*)"
    items = [("exists", c, "info", "max(1)", "max(1)", 1) for c in ("sr_number", "created_date", "sr_type", "status", "ward")]
    items += [("not_null", c, "fail", n, f"count({c})", 1) for c in ("sr_number", "created_date", "sr_type", "status", "ward")]
    items += [("one_of", "status", "fail", "count(status)", "count(*) FILTER (status IN ('OPEN', 'COMPLETED', 'CANCELED'))", 1)]
    items += [("between", "ward", "fail", "count(ward)", "count(*) FILTER (ward BETWEEN 1 AND 50)", 0.99), ("between", "latitude", "fail", "count(*) FILTER (sr_number % 9 <> 0)", "count(*) FILTER (sr_number % 9 <> 0 AND sr_number % 100 >= 60)", 0.99), ("between", "longitude", "fail", n, "count(*) FILTER (sr_number % 100 BETWEEN 50 AND 95)", 0.99)]
    items += [("unique", "sr_number", "fail", "count(sr_number)", "(SELECT count(*) FROM (SELECT sr_number FROM r GROUP BY sr_number HAVING count(*) = 1))", 1)]
    size = f"SELECT 'silver', 'row_count:', 'row_count', '', 'fail', {n}, {n}, {n} >= 1000 FROM r"
    return _checks("silver", items, "r") + " UNION ALL " + size


def _gold_sql() -> str:
    n = "count(*)"
    items = [("exists", c, "info", "max(1)", "max(1)", 1) for c in ("date", "ward", "sr_type", "total_requests", "completion_rate")]
    items += [("not_null", c, "fail", n, f"count({c})", 1) for c in ("date", "ward", "sr_type", "total_requests")]
    items += [("between", "total_requests", "fail", n, "count(*) FILTER (total_requests >= 1)", 1), ("between", "completion_rate", "fail", n, "count(*) FILTER (completion_rate BETWEEN 0 AND 1)", 1), ("between", "ward", "warn", n, "count(*) FILTER (ward BETWEEN 1 AND 50)", 1)]
    items += [("unique_combination", "date,ward,sr_type,is_info_call", "fail", n, "(SELECT count(*) FROM (SELECT count(*) AS k FROM g GROUP BY date, ward, sr_type, is_info_call) WHERE k = 1)", 1)]
    return _checks("gold", items, "g") + f" UNION ALL SELECT 'gold', 'row_count:', 'row_count', '', 'warn', {n}, {n}, {n} >= 100 FROM g"


_G = "g AS (SELECT date, ward, sr_type, is_info_call, count(*) AS total_requests, CAST(count(*) FILTER (status = 'COMPLETED') AS DOUBLE) / count(*) AS completion_rate FROM r GROUP BY date, ward, sr_type, is_info_call)"
_Q = f"{R}, {_G}, q AS ({_silver_sql()} UNION ALL {_gold_sql()})"


@query(f"WITH {_Q} SELECT * FROM q")
def dq_suite_results(spark, sf_dir):
    silver, gold_ = _silver_results(spark, sf_dir), _gold_results(spark, sf_dir)
    return silver.select(F.lit("silver").alias("layer"), "*").unionByName(gold_.select(F.lit("gold").alias("layer"), "*"))


_S = "s AS (SELECT layer, count(*) AS evaluated, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 2) AS success_pct FROM q GROUP BY layer)"


def _summaries(spark, sf_dir):
    out = quality.summary(_silver_results(spark, sf_dir), "silver").unionByName(quality.summary(_gold_results(spark, sf_dir), "gold"))
    return out.withColumn("success_pct", F.col("success_pct").cast("double"))


@query(f"WITH {_Q}, {_S} SELECT * FROM s")
def dq_summary(spark, sf_dir):
    return _summaries(spark, sf_dir)


@query(f"WITH {_Q}, {_S} SELECT min(success_pct) AS lowest_pct, min(success_pct) >= 80 AS passed FROM s")
def dq_gate(spark, sf_dir):
    return quality.gate(_summaries(spark, sf_dir))


@query("SELECT 'lines' AS layer, 'between:l_quantity' AS rule, 'between' AS kind, 'l_quantity' AS \"column\", '{\"checked\":' || count(*) || ',\"good\":' || count(*) FILTER (l_quantity BETWEEN 1 AND 10) || ',\"action\":\"warn\"}' AS details FROM lineitem")
def dq_failed(spark, sf_dir):
    rules = [quality.rule("between", "l_quantity", low=1, high=10), quality.rule("not_null", "l_orderkey")]
    return quality.failed({"lines": quality.evaluate(table(spark, sf_dir, "lineitem"), rules)})


@query(f"""WITH {R}, {_G} SELECT 'row_retention' AS "check", count(*) AS a, (SELECT count(*) FROM orders) AS b, count(*) >= 0.95 * (SELECT count(*) FROM orders) AS success FROM r
 UNION ALL SELECT 'count_consistency', (SELECT CAST(sum(total_requests) AS BIGINT) FROM g WHERE date >= DATE '2001-08-01' - 7), (SELECT count(*) FROM r WHERE date >= DATE '2001-08-01' - 7), abs((SELECT sum(total_requests) FROM g WHERE date >= DATE '2001-08-01' - 7) - (SELECT count(*) FROM r WHERE date >= DATE '2001-08-01' - 7)) < 100""")
def cross_layer_checks(spark, sf_dir):
    rows = requests(spark, sf_dir)
    a = quality.row_retention(rows, table(spark, sf_dir, "orders")).toDF("a", "b", "success")
    b = quality.count_consistency(gold.daily_aggregates(rows), rows, F.lit("2001-08-01").cast("date")).toDF("a", "b", "success")
    return a.select(F.lit("row_retention").alias("check"), "*").unionByName(b.select(F.lit("count_consistency").alias("check"), "*"))


@query(f"""WITH {R}, d AS (SELECT date, count(*) AS y FROM r GROUP BY date), p AS (SELECT date, y, lag(y, 7) OVER (ORDER BY date) AS yhat FROM d), e AS (SELECT *, y - yhat AS err FROM p WHERE yhat IS NOT NULL)
 SELECT count(*) AS n, round(avg(abs(err) / y) * 100, 6) AS mape, round(sqrt(avg(err * err)), 6) AS rmse FROM e""")
def forecast_metrics(spark, sf_dir):
    daily = requests(spark, sf_dir).groupBy(F.to_date("created_date").alias("ds")).agg(F.count("*").alias("y"))
    out = forecast.accuracy(forecast.seasonal_naive(daily, 7))
    return out.select("n", F.round("mape", 6).alias("mape"), F.round("rmse", 6).alias("rmse"))


from servista.plans import queries_flow, queries_quality, queries_scale, queries_series  # noqa: E402, F401
from servista.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402, F401

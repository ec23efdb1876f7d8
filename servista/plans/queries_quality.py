"""Queries of standardisation, quality rules, health bands and exploration over landed records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from servista.functions import clean
from servista.functions.dates import created_hour
from servista.operators import history, profile, quality
from servista.operators.quality import rule
from servista.plans import forecast, gold, monitor, suites
from servista.plans.adapter import RAW_SQL as W, REQUESTS_SQL as R, STAGED_SQL as S, VALID_SQL, VERSIONS_SQL as V, raw, requests, versions
from servista.plans.registry import query

_INFO = f"'{clean.INFO_CALL}'"


def _staged(spark, sf_dir):
    return clean.stage(raw(spark, sf_dir))


@query(f"""WITH {S} SELECT sr_number, sr_type, status, ward, CASE WHEN inside THEN lat END AS latitude, CASE WHEN inside THEN lon END AS longitude, 'WEB' AS origin, is_duplicate,
 sr_type = {_INFO} AS is_info_call, strftime(coalesce(modified, closed, created), '%Y-%m-%d %H:%M:%S') AS sequence FROM s WHERE {VALID_SQL}""")
def staging_clean(spark, sf_dir):
    rows = clean.valid(_staged(spark, sf_dir))
    return rows.select("sr_number", "sr_type", "status", "ward", "latitude", "longitude", "origin", "is_duplicate", "is_info_call", F.date_format("_sequence_timestamp", "yyyy-MM-dd HH:mm:ss").alias("sequence"))


@query(f"WITH {S} SELECT sr_number, ward, status FROM s WHERE sr_number IS NOT NULL AND created IS NOT NULL AND sr_type IS NOT NULL AND status IS NOT NULL AND ward IS NOT NULL")
def strict_rows(spark, sf_dir):
    return clean.strict(_staged(spark, sf_dir)).select("sr_number", "ward", "status")


@query(f"WITH {W} SELECT k AS o_orderkey, sr_type FROM w WHERE sr_type <> {_INFO}")
def service_only(spark, sf_dir):
    return clean.service_only(raw(spark, sf_dir)).select("o_orderkey", "sr_type")


@query(f"""WITH {W}, n AS (SELECT count(*) AS total_records, count(*) FILTER (coalesce(sr_number, '') = '') AS null_sr_number, count(*) FILTER (created_date IS NULL) AS null_created_date, count(*) FILTER (ward = '') AS null_ward,
  count(*) FILTER (latitude IS NOT NULL AND NOT (CAST(latitude AS DOUBLE) BETWEEN 41.6 AND 42.1 AND CAST(longitude AS DOUBLE) BETWEEN -87.95 AND -87.5)) AS invalid_coordinates,
  count(*) FILTER (sr_number <> '') - count(DISTINCT CASE WHEN sr_number <> '' THEN sr_number END) AS duplicate_keys, min(created_date) AS first_date, max(created_date) AS last_date FROM w)
 SELECT *, (null_sr_number + null_created_date)::DOUBLE / total_records < 0.05 AND duplicate_keys::DOUBLE / total_records < 0.05 AS is_valid FROM n""")
def validate_records(spark, sf_dir):
    return quality.validate_records(raw(spark, sf_dir))


@query(f"""WITH {W} SELECT min(CAST(latitude AS DOUBLE)) AS min_latitude, max(CAST(latitude AS DOUBLE)) AS max_latitude, round(avg(CAST(latitude AS DOUBLE)), 9) AS mean_latitude,
 min(CAST(longitude AS DOUBLE)) AS min_longitude, max(CAST(longitude AS DOUBLE)) AS max_longitude, round(avg(CAST(longitude AS DOUBLE)), 9) AS mean_longitude,
 count(*) FILTER (CAST(latitude AS DOUBLE) BETWEEN 41.6 AND 42.1 AND CAST(longitude AS DOUBLE) BETWEEN -87.95 AND -87.5)::DOUBLE / count(latitude) AS inside_share FROM w""")
def coordinate_profile(spark, sf_dir):
    out = profile.coordinates(raw(spark, sf_dir), clean.LATITUDE, clean.LONGITUDE)
    return out.select(*[F.round(c, 9).alias(c) if c.startswith("mean") else F.col(c) for c in out.columns])


@query(f"WITH {S} SELECT CAST(coalesce(hour(created), ward) AS INTEGER) AS hour, count(*) AS n FROM s GROUP BY 1")
def requests_by_hour_or_fallback(spark, sf_dir):
    rows = _staged(spark, sf_dir).select(created_hour(F.col("created_date"), F.col("ward").cast("string")).alias("hour"))
    return rows.groupBy("hour").agg(F.count("*").alias("n"))


def _rows(items: list[tuple[str, str, str, str, str, str]], source: str, layer: str = "") -> str:
    """One SELECT a rule: label, kind, column, action, counts of checked and good as SQL, and the least share."""
    head = f"'{layer}' AS layer, " if layer else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{label}' AS rule, '{kind}' AS kind, '{column}' AS \"column\", '{action}' AS action, CAST({checked} AS BIGINT) AS checked, CAST({good} AS BIGINT) AS good, coalesce(({good})::DOUBLE / nullif({checked}, 0), 1) >= {mostly} AS success FROM {source}"
        for label, kind, column, action, checked, good, mostly in items
    )


def _bronze_sql() -> str:
    n, needed = "count(*)", ("sr_number", "created_date", "sr_type", "status", "ward", "latitude", "longitude")
    once = "(SELECT count(*) FROM (SELECT sr_number FROM w WHERE sr_number IS NOT NULL GROUP BY 1 HAVING count(*) = 1))"
    items = [(f"exists:{c}", "exists", c, "info", "max(1)", "max(1)", "1") for c in needed]
    items += [(f"not_null:{c}", "not_null", c, "fail" if c == "sr_number" else "drop" if c in needed[:4] else "warn", n, f"count({c})", "1" if c in needed[:4] else "0.99") for c in needed]
    items += [("not_null:closed_date", "not_null", "closed_date", "info", n, "count(closed_date)", "0.8"), ("unique:sr_number", "unique", "sr_number", "warn", "count(sr_number)", once, "1")]
    items += [("one_of:status", "one_of", "status", "drop", "count(status)", "count(*) FILTER (status IN ('Open', 'Completed', 'Canceled'))", "0.99")]
    boxes = (("ward", 1, 50), ("latitude", 41.6, 42.1), ("longitude", -87.95, -87.5))
    items += [(f"between:{c}", "between", c, "warn", f"count(TRY_CAST({c} AS DOUBLE))", f"count(*) FILTER (TRY_CAST({c} AS DOUBLE) BETWEEN {a} AND {b})", "0.95") for c, a, b in boxes]
    return _rows(items, "w") + f" UNION ALL SELECT 'row_count:', 'row_count', '', 'warn', {n}, {n}, {n} >= 1000 FROM w"


@query(f"WITH {W} {_bronze_sql()}")
def bronze_rules(spark, sf_dir):
    numbers = {c: F.col(c).try_cast("double") for c in ("ward", "latitude", "longitude")}
    rows = raw(spark, sf_dir).withColumns({"__" + c: x for c, x in numbers.items()})
    typed = rows.drop(*numbers).withColumnsRenamed({"__" + c: c for c in numbers})
    plain = [r for r in suites.BRONZE if not (r.kind == "not_null" and r.column in numbers)]
    text = [r for r in suites.BRONZE if r not in plain]
    return quality.evaluate(typed, plain).unionByName(quality.evaluate(raw(spark, sf_dir), text))


_DROP = [rule("not_null", "sr_number", action="drop"), rule("not_null", "sr_type", action="drop"), rule("one_of", "status", values=clean.STATUSES, action="drop"), rule("between", "ward", low=1, high=50, action="warn")]


@query(f"WITH {S} SELECT sr_number, sr_type, status FROM s WHERE sr_number IS NOT NULL AND sr_type IS NOT NULL AND (status IS NULL OR status IN ('OPEN', 'COMPLETED', 'CANCELED'))")
def enforced_rows(spark, sf_dir):
    return quality.enforce(_staged(spark, sf_dir), _DROP).select("sr_number", "sr_type", "status")


@query(f"""WITH {S} SELECT unnest(['kept', 'not_null:sr_number', 'not_null:sr_type', 'one_of:status', 'rows']) AS counter, unnest([count(*) FILTER (sr_number IS NOT NULL AND sr_type IS NOT NULL AND (status IS NULL OR status IN ('OPEN', 'COMPLETED', 'CANCELED'))),
 count(*) FILTER (sr_number IS NULL), count(*) FILTER (sr_type IS NULL), count(*) FILTER (status NOT IN ('OPEN', 'COMPLETED', 'CANCELED')), count(*)]) AS n FROM s""")
def drop_counters(spark, sf_dir):
    kept, seen = quality.enforce_counted(_staged(spark, sf_dir), _DROP)
    n = kept.count()
    return spark.createDataFrame([("kept", n), *seen.get.items()], "counter string, n long")


@query(f"""WITH {S}, v AS (SELECT CASE WHEN sr_type IS NULL THEN 'not_null:sr_type' END AS a, CASE WHEN status NOT IN ('OPEN', 'COMPLETED', 'CANCELED') THEN 'one_of:status' END AS b, CASE WHEN ward NOT BETWEEN 1 AND 50 THEN 'between:ward' END AS c, CASE WHEN sr_number IS NULL THEN 'not_null:sr_number' END AS d FROM s)
 SELECT x AS violation, count(*) AS n FROM (SELECT unnest([a, b, c, d]) AS x FROM v) WHERE x IS NOT NULL GROUP BY x""")
def quarantine_counts(spark, sf_dir):
    rows = quality.with_violations(_staged(spark, sf_dir), _DROP)
    return rows.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


#: A rule file as a parser gives it: sections by layer and table, other sections beside them.
RULE_FILE = {
    "source": {"name": "orders"},
    "silver": {
        "staged": {
            "expectations": [
                {"name": "required", "type": "not_null", "columns": ["sr_number", "sr_type"], "action": "fail"},
                {"name": "ward_valid", "type": "between", "column": "ward", "min": 1, "max": 50, "mostly": 0.9, "action": "warn"},
                {"name": "ward_given", "type": "between", "column": "ward", "min": 1, "max": 50, "mostly": 0.9, "allow_null": False, "action": "warn"},
                {"name": "latitude_valid", "type": "between", "column": "latitude", "min": 41.6, "max": 42.1, "allow_null": True, "action": "warn"},
                {"name": "statuses", "type": "one_of", "column": "status", "values": ["OPEN", "COMPLETED", "CANCELED"], "allow_null": False},
                {"name": "wards_seen", "type": "custom_sql", "sql": "count(DISTINCT ward) > 50"},
                {"name": "hours", "type": "greater_than", "column": "ward", "value": 0, "mostly": 0.9},
            ]
        }
    },
    "gold": {
        "days": {
            "written_by": "daily job",
            "expectations": [
                {"name": "one_row_a_day", "type": "unique", "column": "date"},
                {"name": "calendar", "type": "between", "column": "day_of_week", "min": 1, "max": 7, "action": "fail"},
                {"name": "busy_enough", "type": "greater_than", "column": "total_requests", "value": 3, "mostly": 0.5},
                {"name": "parts_add_up", "type": "custom_sql", "sql": "sum(service_requests) + sum(info_calls) = sum(total_requests)", "action": "fail"},
            ],
        }
    },
    "between_tables": {
        "days_of_requests": {
            "expectations": [
                {"name": "no_type_lost", "type": "custom_sql", "sql": "(SELECT count(DISTINCT sr_type) FROM grouped) = (SELECT count(DISTINCT sr_type) FROM single)", "action": "fail"},
                {"name": "busiest_ward", "type": "custom_sql", "sql": "(SELECT max(n) FROM (SELECT sum(total_requests) AS n FROM grouped GROUP BY ward)) = (SELECT max(n) FROM (SELECT count(*) AS n FROM single GROUP BY ward))"},
                {"name": "mostly_staged", "type": "custom_sql", "sql": "(SELECT count(*) FROM staged) > 2 * (SELECT count(*) FROM single)"},
            ]
        }
    },
}


def _rule_file_sql() -> str:
    n, w = "count(*)", "count(*) FILTER (ward BETWEEN 1 AND 50)"
    silver = [
        ("required", "not_null", "sr_number", "fail", n, "count(sr_number)", "1"),
        ("required", "not_null", "sr_type", "fail", n, "count(sr_type)", "1"),
        ("ward_valid", "between", "ward", "warn", "count(ward)", w, "0.9"),
        ("ward_given", "between", "ward", "warn", n, w, "0.9"),
        ("latitude_valid", "between", "latitude", "warn", "count(*) FILTER (inside)", "count(*) FILTER (inside)", "1"),
        ("statuses", "one_of", "status", "info", n, "count(*) FILTER (status IN ('OPEN', 'COMPLETED', 'CANCELED'))", "1"),
        ("wards_seen", "sql", "", "info", "max(1)", "CAST(count(DISTINCT ward) > 50 AS INTEGER)", "1"),
        ("hours", "greater_than", "ward", "info", "count(ward)", "count(*) FILTER (ward > 0)", "0.9"),
    ]
    days = [
        ("one_row_a_day", "unique", "date", "info", n, n, "1"),
        ("calendar", "between", "day_of_week", "fail", n, n, "1"),
        ("busy_enough", "greater_than", "total_requests", "info", n, "count(*) FILTER (total > 3)", "0.5"),
        ("parts_add_up", "sql", "", "fail", "max(1)", "CAST(sum(service) + sum(info) = sum(total) AS INTEGER)", "1"),
    ]
    return f"{_rows(silver, 's', 'silver.staged')} UNION ALL {_rows(days, 'c', 'gold.days')}"


@query(f"WITH {S}, {R}, c AS (SELECT date, count(*) AS total, count(*) FILTER (is_info_call) AS info, count(*) FILTER (NOT is_info_call) AS service FROM r GROUP BY date) {_rule_file_sql()}")
def rule_file_results(spark, sf_dir):
    rules = quality.from_yaml(RULE_FILE)
    silver = quality.evaluate(_staged(spark, sf_dir), rules["silver"]["staged"])
    days = quality.evaluate(gold.citywide_daily_summary(requests(spark, sf_dir)), rules["gold"]["days"])
    return quality.ordered(silver.select(F.lit("silver.staged").alias("layer"), "*").unionByName(days.select(F.lit("gold.days").alias("layer"), "*")))


@query(f"""WITH {S}, {R}, n AS (SELECT (SELECT count(*) FROM s) AS staged, (SELECT count(*) FROM r) AS single)
 SELECT unnest(['no_type_lost', 'busiest_ward', 'mostly_staged']) AS rule, 'sql' AS kind, '' AS "column", unnest(['fail', 'info', 'info']) AS action, 1::BIGINT AS checked, unnest([1, 1, (staged > 2 * single)::BIGINT]) AS good, unnest([true, true, staged > 2 * single]) AS success FROM n""")
def cross_layer_rule_file(spark, sf_dir):
    rows = requests(spark, sf_dir)
    tables = {"single": rows, "staged": _staged(spark, sf_dir), "grouped": gold.daily_aggregates(rows)}
    return quality.across(spark, quality.from_yaml(RULE_FILE)["between_tables"]["days_of_requests"], tables)


@query(f"WITH {V} {_rows([('not_null:sr_number', 'not_null', 'sr_number', 'fail', 'count(*)', 'count(sr_number)', '1'), ('not_null:__START_AT', 'not_null', '__START_AT', 'fail', 'count(*)', 'count(version_start)', '1'), ('version_rate_healthy', 'sql', '', 'warn', 'max(1)', 'CAST(round(count(*) * 1.0 / count(DISTINCT sr_number), 2) BETWEEN 1.0 AND 2.0 AS INTEGER)', '1')], 'v')}")
def history_rules(spark, sf_dir):
    return quality.evaluate(versions(spark, sf_dir), suites.SCD2)


_REPORT = [rule("not_null", "status"), rule("between", "ward", low=1, high=50), rule("exists", "ward")]


@query(f"""WITH {S}, x AS (SELECT 1 + (count(*) = count(status))::INTEGER + (count(ward) = count(*) FILTER (ward BETWEEN 1 AND 50))::INTEGER AS good FROM s)
 SELECT '[{{"layer":"staged","evaluated":3,"successful":' || good || ',"failed":' || (3 - good) || ',"success_pct":' || CASE good WHEN 1 THEN '33.33' WHEN 2 THEN '66.67' ELSE '100.0' END || '}}]' AS report FROM x""")
def quality_report(spark, sf_dir):
    out = quality.summary(quality.evaluate(_staged(spark, sf_dir), _REPORT), "staged")
    return quality.report(out.withColumn("success_pct", F.col("success_pct").cast("double")))


@query(f"""WITH {R}, d AS (SELECT CAST(date AS VARCHAR) AS date, avg(is_info_call::INTEGER) AS info, avg((status = 'COMPLETED')::INTEGER) AS completed FROM r GROUP BY r.date)
 SELECT date, CASE WHEN info BETWEEN 0.35 AND 0.45 THEN 'OK' WHEN info BETWEEN 0.3 AND 0.5 THEN 'WARNING' ELSE 'CRITICAL' END AS info_band, CASE WHEN completed BETWEEN 0.8 AND 0.9 THEN 'OK' WHEN completed BETWEEN 0.7 AND 0.95 THEN 'WARNING' ELSE 'CRITICAL' END AS completion_band FROM d""")
def daily_bands(spark, sf_dir):
    days = requests(spark, sf_dir).groupBy(F.to_date("created_date").cast("string").alias("date")).agg(F.avg(F.col("is_info_call").cast("int")).alias("info"), F.avg((F.col("status") == "COMPLETED").cast("int")).alias("completed"))
    return days.select("date", monitor.bands(F.col("info"), (0.35, 0.45), (0.3, 0.5)).alias("info_band"), monitor.bands(F.col("completed"), (0.8, 0.9), (0.7, 0.95)).alias("completion_band"))


@query("""SELECT user_id, date_sub('hour', max(ts), TIMESTAMP '2024-01-31 00:00:00') AS hours, CASE WHEN date_sub('hour', max(ts), TIMESTAMP '2024-01-31 00:00:00') > 48 THEN 'CRITICAL' WHEN date_sub('hour', max(ts), TIMESTAMP '2024-01-31 00:00:00') > 24 THEN 'WARNING' ELSE 'OK' END AS band FROM events GROUP BY user_id""")
def freshness_bands(spark, sf_dir):
    from servista.functions.dates import hours_between

    last = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(hours_between(F.max("ts"), F.lit("2024-01-31").cast("timestamp")).alias("hours"))
    return last.withColumn("band", monitor.freshness_band(F.col("hours")))


@query(f"WITH {W} SELECT k AS o_orderkey, sr_number FROM w WHERE sr_number IN (SELECT sr_number FROM w WHERE sr_number IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def rows_of_repeated_keys(spark, sf_dir):
    return quality.duplicates(raw(spark, sf_dir), "sr_number").select("o_orderkey", "sr_number")


@query(f"WITH {R} SELECT ward, count(*) AS n, median(resolution_hours) AS median FROM r WHERE ward IN (SELECT DISTINCT ward FROM r ORDER BY ward LIMIT 10) GROUP BY ward")
def median_of_smallest_wards(spark, sf_dir):
    return profile.median_of_smallest(requests(spark, sf_dir), "resolution_hours", "ward")


@query(f"WITH {R} SELECT sr_type, count(*) AS n, avg((status = 'COMPLETED')::INTEGER) AS completed_share FROM r WHERE ward = 7 GROUP BY sr_type ORDER BY n DESC, sr_type LIMIT 10")
def ward_breakdown(spark, sf_dir):
    return profile.breakdown(requests(spark, sf_dir), "ward", 7)


@query(f"WITH {R} SELECT count(resolution_hours) AS closed, count(*) FILTER (resolution_hours <= 0.1) AS instant, count(*) FILTER (resolution_hours < 24) AS within_a_day, count(*) FILTER (is_info_call) AS info_calls, count(*) FILTER (ward IS NULL) AS without_ward FROM r")
def insight_counts(spark, sf_dir):
    return profile.insights(requests(spark, sf_dir))


@query(f"""WITH {R}, d AS (SELECT date, count(*) AS n FROM r GROUP BY date), o AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) SELECT CAST(date AS VARCHAR) AS date, n, quantity FROM d LEFT JOIN o ON d.date = o.day""")
def daily_with_other_table(spark, sf_dir):
    days = requests(spark, sf_dir).groupBy(F.to_date("created_date").alias("date")).agg(F.count("*").alias("n"))
    other = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("quantity"))
    return profile.with_daily(days, other, other_date="day").withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {R}, d AS (SELECT ward, date, count(*) AS total_requests FROM r GROUP BY ward, date), e AS (SELECT ward, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY ward),
 f AS (SELECT e.ward, e.date, coalesce(total_requests, 0) AS total_requests FROM e LEFT JOIN d ON e.ward = d.ward AND e.date = d.date)
 SELECT ward, CAST(date AS VARCHAR) AS date, total_requests, avg(total_requests) OVER (PARTITION BY ward ORDER BY f.date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS last_week FROM f""")
def calendar_rolling_by_ward(spark, sf_dir):
    from pyspark.sql import Window

    days = requests(spark, sf_dir).groupBy("ward", F.to_date("created_date").alias("date")).agg(F.count("*").alias("total_requests"))
    full = gold.densified(days, "ward", ["total_requests"])
    week = F.avg("total_requests").over(Window.partitionBy("ward").orderBy("date").rowsBetween(-7, -1))
    return full.select("ward", F.col("date").cast("string").alias("date"), "total_requests", week.alias("last_week"))


@query(f"WITH {V} SELECT sr_number, status, version_start AS valid_from, CASE WHEN status <> 'view' THEN 24::BIGINT END AS resolution_hours FROM v WHERE version_end IS NULL")
def current_requests(spark, sf_dir):
    rows = versions(spark, sf_dir)
    closed = F.when(F.col("status") != "view", F.col(history.START) + F.expr("INTERVAL 1 DAY"))
    out = history.current_requests(rows.withColumn("created_date", F.col(history.START)).withColumn("closed_date", closed))
    return out.select("sr_number", "status", "valid_from", "resolution_hours")


_FORECAST = f"""{R}, d AS (SELECT date, count(*) AS y FROM r GROUP BY date), p AS (SELECT date, y, lag(y, 7) OVER (ORDER BY date) AS yhat FROM d), e AS (SELECT * FROM p WHERE yhat IS NOT NULL),
 b AS (SELECT *, 2 * (SELECT stddev_samp(y - yhat) FROM e) AS width FROM e)"""


def _forecast(spark, sf_dir):
    daily = requests(spark, sf_dir).groupBy(F.to_date("created_date").alias("ds")).agg(F.count("*").alias("y"))
    return forecast.seasonal_naive(daily, 7)


@query(f"WITH {_FORECAST} SELECT CAST(date AS VARCHAR) AS ds, y, yhat, y > yhat + width AS is_anomaly, round(CASE WHEN y > yhat + width THEN (y - yhat - width) / (yhat + width) END, 6) AS anomaly_score FROM b")
def forecast_anomalies(spark, sf_dir):
    out = forecast.forecast_anomalies(_forecast(spark, sf_dir))
    return out.select(F.col("ds").cast("string").alias("ds"), "y", "yhat", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


@query(f"WITH {_FORECAST} SELECT round(avg((y BETWEEN yhat - width AND yhat + width)::INTEGER), 9) AS coverage FROM b")
def forecast_coverage(spark, sf_dir):
    return forecast.accuracy(_forecast(spark, sf_dir)).select(F.round("coverage", 9).alias("coverage"))


@query(f"WITH {_FORECAST} SELECT count(*) FILTER (y > yhat + width AND y > 10)::DOUBLE / nullif(count(*) FILTER (y > yhat + width), 0) AS precision, count(*) FILTER (y > yhat + width AND y > 10)::DOUBLE / nullif(count(*) FILTER (y > 10), 0) AS recall FROM b")
def anomaly_precision_recall(spark, sf_dir):
    flags = forecast.forecast_anomalies(_forecast(spark, sf_dir)).select(F.col("is_anomaly").alias("predicted"), (F.col("y") > 10).alias("actual"))
    return forecast.precision_recall(flags)

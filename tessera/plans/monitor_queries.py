"""Registered monitoring queries over the measurement log (S8, F6, F7, F13, F15, M16, A1-A6,
T1-T3)."""

from __future__ import annotations

from tessera.operators import monitor as M
from tessera.plans.base import AS_OF, register
from tessera.plans.fixture_sql import with_ctes
from tessera.sources.fixtures import measurement_log, thresholds


def results(spark, sf_dir):
    """Results with PASS/FAIL from the threshold policy (whole log)."""
    return M.threshold_status(M.quality_results(measurement_log(spark, sf_dir)), thresholds(spark))


_RESULT_COLS = ("result_id, monitor_name, database_name, schema_name, table_name, column_name, "
                "metric_value, metric_unit, threshold_min, threshold_max, status, "
                "measurement_time, record_inserted_at")


@register("quality_results", with_ctes(f"""
SELECT {_RESULT_COLS} FROM (
  SELECT result_id, metric_name AS monitor_name, table_database AS database_name,
    table_schema AS schema_name, table_name,
    CASE WHEN arg_type = 'COLUMN' AND arg_name IS NOT NULL THEN arg_name END AS column_name,
    value AS metric_value, 'numeric' AS metric_unit,
    CAST(NULL AS DOUBLE) AS threshold_min, CAST(NULL AS DOUBLE) AS threshold_max,
    CASE WHEN value IS NOT NULL THEN 'MEASURED' ELSE 'UNKNOWN' END AS status,
    measurement_time, measurement_time AS record_inserted_at
  FROM qr) s
ORDER BY measurement_time DESC, result_id DESC LIMIT 1000""", "qr"))
def quality_results(spark, sf_dir):
    return M.newest(M.quality_results(measurement_log(spark, sf_dir)), 1000)


@register("threshold_status", with_ctes("""
SELECT result_id, monitor_name, metric_value, threshold_min, threshold_max, status FROM qres""",
                                         "qres"))
def threshold_status(spark, sf_dir):
    return results(spark, sf_dir).select("result_id", "monitor_name", "metric_value",
                                         "threshold_min", "threshold_max", "status")


@register("results_scope_filter", with_ctes("""
SELECT result_id, database_name, schema_name, table_name, monitor_name FROM qres
WHERE database_name IN ('DB0', 'DB1')
  AND ((database_name = 'DB0' AND schema_name = 'S0') OR (database_name = 'DB1' AND schema_name = 'S1'))""",
                                             "qres"))
def results_scope_filter(spark, sf_dir):
    df = M.scope_filter(results(spark, sf_dir), ["DB0", "DB1"], ["DB0.S0", "DB1.S1"])
    return df.select("result_id", "database_name", "schema_name", "table_name", "monitor_name")


_MANY = [f"DB{i % 3}.S{i}" for i in range(200)]


@register("results_scope_many", with_ctes(f"""
SELECT result_id, database_name, schema_name, table_name, monitor_name, status FROM qres
WHERE database_name || '.' || schema_name IN ({", ".join(f"'{x}'" for x in _MANY)})""", "qres"))
def results_scope_many(spark, sf_dir):
    """Many pairs: the same columns in the same order as with few."""
    df = M.scope_filter(results(spark, sf_dir), (), _MANY)
    return df.select("result_id", "database_name", "schema_name", "table_name", "monitor_name", "status")


def _range_query(key: str, interval: str):
    sql = with_ctes(f"""
SELECT result_id, monitor_name, table_name, status, measurement_time FROM qres
WHERE measurement_time >= TIMESTAMP '{AS_OF}' - INTERVAL {interval}""", "qres")

    @register(f"results_last_{key}", sql)
    def q(spark, sf_dir):
        return M.time_range(results(spark, sf_dir), key, AS_OF).select(
            "result_id", "monitor_name", "table_name", "status", "measurement_time")
    return q


_range_query("24h", "24 HOUR")
_range_query("7d", "7 DAY")
_range_query("30d", "30 DAY")


MONITOR_SQL = """
SELECT database_name, schema_name, table_name, column_name, monitor_name AS monitor_type,
  max(measurement_time) AS last_check,
  max(CASE WHEN rn = 1 THEN status END) AS last_status,
  max(measurement_time) AS configured_at,
  min(measurement_time) AS first_seen
FROM (SELECT *, row_number() OVER (
        PARTITION BY database_name, schema_name, table_name, column_name, monitor_name
        ORDER BY measurement_time DESC, result_id DESC) AS rn FROM qres) r
GROUP BY database_name, schema_name, table_name, column_name, monitor_name"""


def monitors(spark, sf_dir):
    return M.monitor_summary(results(spark, sf_dir))


@register("monitor_summary", with_ctes(MONITOR_SQL, "qres"))
def monitor_summary(spark, sf_dir):
    return monitors(spark, sf_dir)


@register("table_summary", with_ctes(f"""
SELECT database_name, schema_name, table_name,
  array_to_string(list_sort(list_distinct(list(monitor_type))), ', ') AS monitor_types,
  count(column_name) AS columns_monitored, max(last_check) AS last_check,
  CASE WHEN count(DISTINCT last_status) > 1 THEN 'MIXED' ELSE min(last_status) END AS overall_status
FROM ({MONITOR_SQL}) m GROUP BY database_name, schema_name, table_name""", "qres"))
def table_summary(spark, sf_dir):
    return M.table_summary(monitors(spark, sf_dir))


@register("monitor_kpis", with_ctes("""
SELECT (SELECT count(*) FROM (SELECT DISTINCT database_name, schema_name, table_name, column_name,
          monitor_name FROM qres) d) AS active_monitors,
       count(DISTINCT table_name) AS tables_monitored, count(*) AS quality_checks FROM qres""", "qres"))
def monitor_kpis(spark, sf_dir):
    return M.monitor_kpis(results(spark, sf_dir))


@register("pass_rate", with_ctes("""
SELECT round(avg(CASE WHEN status = 'PASS' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 1) AS pass_rate
FROM qres""", "qres"))
def pass_rate(spark, sf_dir):
    return M.pass_rate(results(spark, sf_dir))


@register("monitor_type_counts", with_ctes(f"""
SELECT monitor_type, count(*) AS n FROM ({MONITOR_SQL}) m
WHERE monitor_type IS NOT NULL GROUP BY monitor_type""", "qres"))
def monitor_type_counts(spark, sf_dir):
    return M.value_counts(monitors(spark, sf_dir), "monitor_type")


@register("status_counts", with_ctes("""
SELECT status, count(*) AS n FROM qres WHERE status IS NOT NULL GROUP BY status""", "qres"))
def status_counts(spark, sf_dir):
    return M.value_counts(results(spark, sf_dir), "status")


@register("recent_monitors", with_ctes(f"""
SELECT * FROM ({MONITOR_SQL}) m
ORDER BY last_check DESC, database_name NULLS FIRST, schema_name NULLS FIRST,
  table_name NULLS FIRST, column_name NULLS FIRST, monitor_type NULLS FIRST LIMIT 5""", "qres"))
def recent_monitors(spark, sf_dir):
    return M.recent_monitors(monitors(spark, sf_dir), 5)


@register("recent_failures", with_ctes("""
SELECT result_id, monitor_name, database_name, schema_name, table_name, column_name,
  metric_value, threshold_min, threshold_max, status, measurement_time
FROM qres WHERE status = 'FAIL' ORDER BY measurement_time DESC, result_id DESC LIMIT 3""", "qres"))
def recent_failures(spark, sf_dir):
    return M.recent_failures(results(spark, sf_dir), 3).select(
        "result_id", "monitor_name", "database_name", "schema_name", "table_name", "column_name",
        "metric_value", "threshold_min", "threshold_max", "status", "measurement_time")


@register("results_listing_newest", with_ctes("""
SELECT result_id, monitor_name, table_name, status, measurement_time FROM qres
ORDER BY measurement_time DESC, result_id DESC LIMIT 1000""", "qres"))
def results_listing_newest(spark, sf_dir):
    return M.newest(results(spark, sf_dir), 1000).select(
        "result_id", "monitor_name", "table_name", "status", "measurement_time")


"""Registered check-configuration queries (M13-M15, A15) and the configuration audit flow
(K2 via X4: statements parsed back)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions.names import METRIC_NAMESPACE
from tessera.operators import checks as CK
from tessera.operators.history import metric_change_rows
from tessera.plans.base import AS_OF, register
from tessera.plans.fixture_sql import with_ctes
from tessera.plans.oracle_sql import sql_fq, sql_quote
from tessera.sinks.tables import append_and_read
from tessera.sources.fixtures import catalog_columns

_KEYS = "table_catalog, table_schema, table_name"
_TEMPORAL = " OR ".join(f"contains(upper(data_type), '{t}')" for t in
                        ("DATE", "TIME", "TIMESTAMP", "TIMESTAMP_LTZ", "TIMESTAMP_NTZ", "TIMESTAMP_TZ"))
_BY_NAME = " OR ".join(f"contains(upper(column_name), '{w}')" for w in CK.FRESHNESS_NAME_WORDS)


def _compat_sql(metrics) -> str:
    parts = []
    for m in metrics:
        where = f"WHERE {_TEMPORAL}" if m == "FRESHNESS" else ""
        parts.append(f"SELECT {_KEYS}, column_name, data_type, '{m}' AS metric_name FROM cols {where}")
    return " UNION ALL ".join(parts)


@register("compatible_metrics", with_ctes(
    _compat_sql(["FRESHNESS", "NULL_COUNT", "DUPLICATE_COUNT", "UNIQUE_COUNT"]), "cols"))
def compatible_metrics(spark, sf_dir):
    return CK.compatible_metrics(catalog_columns(spark, sf_dir))


@register("columns_by_type", with_ctes(f"""
SELECT {_KEYS}, data_type, array_to_string(list_sort(list(column_name)), ', ') AS columns,
  count(*) AS n_columns FROM cols GROUP BY {_KEYS}, data_type""", "cols"))
def columns_by_type(spark, sf_dir):
    return CK.columns_by_type(catalog_columns(spark, sf_dir))


@register("freshness_candidates", with_ctes(f"""
SELECT {_KEYS}, column_name, data_type, ({_BY_NAME}) AS by_name, ({_TEMPORAL}) AS by_type
FROM cols WHERE ({_BY_NAME}) OR ({_TEMPORAL})""", "cols"))
def freshness_candidates(spark, sf_dir):
    return CK.freshness_candidates(catalog_columns(spark, sf_dir))


_EXPAND = f"""
SELECT {_KEYS}, metric_name, column_name,
  'ALTER TABLE ' || {sql_fq('table_catalog', 'table_schema', 'table_name')} ||
  ' ADD DATA METRIC FUNCTION {METRIC_NAMESPACE}.' || metric_name || ' ON (' ||
  coalesce({sql_quote('column_name')}, '') || ');' AS statement
FROM (
  SELECT DISTINCT {_KEYS}, 'ROW_COUNT' AS metric_name, CAST(NULL AS VARCHAR) AS column_name FROM cols
  UNION ALL
  SELECT {_KEYS}, 'FRESHNESS', first(column_name ORDER BY CASE WHEN {_BY_NAME} THEN 0 ELSE 1 END, ordinal_position)
  FROM cols WHERE {_TEMPORAL} GROUP BY {_KEYS}
  UNION ALL
  SELECT {_KEYS}, metric_name, column_name FROM ({_compat_sql(["NULL_COUNT", "DUPLICATE_COUNT", "UNIQUE_COUNT"])}) c
) x"""


@register("expand_checks", with_ctes(_EXPAND, "cols"))
def expand_checks(spark, sf_dir):
    return CK.expand_checks(catalog_columns(spark, sf_dir))


@register("check_counts", with_ctes(f"""
SELECT {_KEYS}, count(*) FILTER (WHERE column_name IS NULL) AS table_level_checks,
  count(DISTINCT column_name) AS columns_configured,
  count(*) FILTER (WHERE column_name IS NOT NULL) AS column_level_checks
FROM ({_EXPAND}) e GROUP BY {_KEYS}""", "cols"))
def check_counts(spark, sf_dir):
    return CK.check_counts(CK.expand_checks(catalog_columns(spark, sf_dir)))


_PARSE_T = "regexp_extract(upper(statement), '{p}', 1)".format(p=N.TABLE_PATTERN)
_PARSE_M = "regexp_extract(upper(statement), '{p}', 1)".format(p=N.metric_pattern())
_PARSE_C = "regexp_replace(regexp_extract(statement, '{p}', 1), '^\\s+|\\s+$', '', 'g')".format(
    p=N.COLUMN_PATTERN)


@register("configure_and_log", with_ctes(f"""
SELECT table_catalog AS database_name, table_schema AS schema_name,
  'DMF_' || metric || CASE WHEN col IS NOT NULL AND col <> '' THEN '_COLUMN' ELSE '' END AS object_type,
  tbl AS object_name, col AS column_name, CAST(NULL AS VARCHAR) AS before_description,
  'Added ' || metric || ' data quality metric' ||
    CASE WHEN col IS NOT NULL AND col <> '' THEN ' to column ' || col ELSE '' END AS after_description,
  CAST(NULL AS VARCHAR) AS sql_executed, 'tessera' AS updated_by,
  CAST(TIMESTAMP '{AS_OF}' AS TIMESTAMP) AS updated_at
FROM (
  SELECT table_catalog, table_schema,
    regexp_replace(coalesce(nullif({_PARSE_T}, ''), '{N.UNKNOWN_TABLE}'), '^"+|"+$', '', 'g') AS tbl,
    coalesce(nullif({_PARSE_M}, ''), '{N.UNKNOWN_METRIC}') AS metric,
    CASE WHEN {_PARSE_C} <> '' THEN
      regexp_replace(regexp_replace({_PARSE_C}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') END AS col
  FROM ({_EXPAND}) e) p""", "cols"))
def configure_and_log(spark, sf_dir):
    """Configuration -> statements -> each statement parsed back (table, metric, column,
    as the statement log does) -> ADDED metric changes appended to the audit log."""
    checks = CK.expand_checks(catalog_columns(spark, sf_dir))
    parsed = checks.select(F.col("table_catalog").alias("database_name"),
                           F.col("table_schema").alias("schema_name"),
                           N.parse_metric_statement("statement").alias("p"))
    cfg = parsed.select("database_name", "schema_name", "p.table_name",
                        F.col("p.metric_name").alias("metric_name"), "p.column_name")
    rows = metric_change_rows(cfg, "ADDED", updated_by="tessera", updated_at=AS_OF)
    return append_and_read(rows, "metric_history")

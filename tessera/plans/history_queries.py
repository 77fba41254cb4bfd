"""Registered audit-history, export and results-writer queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.names import METRIC_NAMESPACE, metric_statement
from tessera.operators import history as H
from tessera.operators import monitor as M
from tessera.operators.contacts import contact_change_requests, contact_path
from tessera.operators.metrics import METRIC_UNITS
from tessera.plans.base import AS_OF, register
from tessera.plans.fixture_sql import THRESH, with_ctes
from tessera.plans.metric_queries import SUITE, plan_sql, run_plan
from tessera.plans.monitor_queries import MONITOR_SQL, monitors
from tessera.plans.oracle_sql import comment_statement_sql, sql_fq, sql_quote
from tessera.session import scratch_path, unique_name
from tessera.sinks.tables import append_and_read, export_csv, log_run, read_csv, with_hash_id, write_run
from tessera.sources.fixtures import audit_log, contact_refs, measurement_log, thresholds

_HCOLS = ("history_id, database_name, schema_name, object_type, object_name, column_name, "
          "before_description, after_description, updated_by, updated_at")
_DESC_WHERE = "object_type NOT LIKE 'DMF_%' AND object_type NOT LIKE 'CONTACT_%'"


@register("history_descriptions", with_ctes(f"""
SELECT {_HCOLS} FROM hist WHERE {_DESC_WHERE}
ORDER BY updated_at DESC, history_id DESC LIMIT 1000""", "hist"))
def history_descriptions(spark, sf_dir):
    return H.newest_changes(H.description_history(audit_log(spark, sf_dir)), 1000)


@register("history_metrics", with_ctes("""
SELECT history_id, database_name, schema_name, object_type, object_name, column_name,
  after_description AS action_description, updated_by, updated_at
FROM hist WHERE object_type LIKE 'DMF_%'
ORDER BY updated_at DESC, history_id DESC LIMIT 500""", "hist"))
def history_metrics(spark, sf_dir):
    return H.newest_changes(H.metric_history(audit_log(spark, sf_dir)), 500)


@register("history_summary", with_ctes(f"""
SELECT count(*) AS total_changes, count(DISTINCT object_name) AS unique_objects,
  count(DISTINCT updated_by) AS unique_users FROM hist WHERE {_DESC_WHERE}""", "hist"))
def history_summary(spark, sf_dir):
    return H.history_summary(H.description_history(audit_log(spark, sf_dir)))


@register("metric_history_summary", with_ctes("""
SELECT count(*) AS dmf_changes, count(DISTINCT object_name) AS tables_configured,
  count(DISTINCT object_type) AS unique_metrics FROM hist WHERE object_type LIKE 'DMF_%'""", "hist"))
def metric_history_summary(spark, sf_dir):
    return H.metric_history_summary(H.metric_history(audit_log(spark, sf_dir)))


_OUT = ("database_name, schema_name, object_type, object_name, column_name, before_description, "
        "after_description, sql_executed, updated_by, updated_at")


@register("history_append_descriptions", with_ctes(f"""
SELECT {_OUT} FROM (
  SELECT database_name, schema_name, object_type, object_name,
    CASE WHEN object_type = 'COLUMN' THEN column_name END AS column_name,
    nullif(before_description, '') AS before_description,
    nullif(after_description, '') AS after_description,
    {comment_statement_sql('object_type', 'database_name', 'schema_name', 'object_name',
                  "CASE WHEN object_type = 'COLUMN' THEN column_name END", 'after_description')}
      AS sql_executed,
    'tessera' AS updated_by, CAST(TIMESTAMP '{AS_OF}' AS TIMESTAMP) AS updated_at
  FROM hist WHERE object_type IN ('TABLE', 'VIEW', 'COLUMN')) s""", "hist"))
def history_append_descriptions(spark, sf_dir):
    """Description changes (COLUMN names arrive as 'table.column') -> history log append."""
    h = audit_log(spark, sf_dir).filter(F.col("object_type").isin("TABLE", "VIEW", "COLUMN"))
    changes = h.select(
        "database_name", "schema_name", "object_type",
        F.when(F.col("object_type") == "COLUMN",
               F.concat_ws(".", "object_name", "column_name")).otherwise(F.col("object_name"))
         .alias("object_name"),
        "before_description", "after_description")
    rows = H.description_change_rows(changes, updated_by="tessera", updated_at=AS_OF)
    return append_and_read(rows, "description_history")


_MON = """SELECT DISTINCT table_database AS database_name, table_schema AS schema_name, table_name,
    metric_name, CASE WHEN arg_type = 'COLUMN' THEN arg_name END AS column_name FROM qr"""


_ID_SQL = " || ".join(
    f"coalesce('V' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in H.ID_PARTS)


@register("history_roundtrip", with_ctes(f"""
SELECT sha256({_ID_SQL}) AS history_id, database_name, schema_name, object_type, object_name, column_name,
  before_description, after_description, updated_by, updated_at
FROM (SELECT database_name, schema_name, object_type, object_name,
        CASE WHEN object_type = 'COLUMN' THEN column_name END AS column_name,
        nullif(before_description, '') AS before_description, nullif(after_description, '') AS after_description,
        'tessera' AS updated_by, CAST(TIMESTAMP '{AS_OF}' AS TIMESTAMP) AS updated_at
      FROM hist WHERE object_type IN ('TABLE', 'VIEW', 'COLUMN')) s
ORDER BY updated_at DESC, history_id DESC LIMIT 1000""", "hist"))
def history_roundtrip(spark, sf_dir):
    """The newest changes of a log this engine wrote itself; the run is logged twice, as a
    retried job would, and counts once."""
    h = audit_log(spark, sf_dir).filter(F.col("object_type").isin("TABLE", "VIEW", "COLUMN"))
    changes = h.select(
        "database_name", "schema_name", "object_type",
        F.when(F.col("object_type") == "COLUMN",
               F.concat_ws(".", "object_name", "column_name")).otherwise(F.col("object_name")).alias("object_name"),
        "before_description", "after_description")
    rows = H.with_history_id(H.description_change_rows(changes, updated_by="tessera", updated_at=AS_OF))
    path = scratch_path(spark, "history", unique_name("history_roundtrip"))
    for _ in range(2):
        log_run(rows, path, "run-1")
    return H.newest_changes(H.description_history(spark.read.parquet(path)), 1000)


@register("history_append_metrics", with_ctes(f"""
SELECT database_name, schema_name,
  'DMF_' || metric_name || CASE WHEN column_name IS NOT NULL AND column_name <> '' THEN '_COLUMN' ELSE '' END
    AS object_type,
  table_name AS object_name, column_name, CAST(NULL AS VARCHAR) AS before_description,
  'Added ' || metric_name || ' data quality metric' ||
    CASE WHEN column_name IS NOT NULL AND column_name <> '' THEN ' to column ' || column_name ELSE '' END
    AS after_description,
  CAST(NULL AS VARCHAR) AS sql_executed, 'tessera' AS updated_by,
  CAST(TIMESTAMP '{AS_OF}' AS TIMESTAMP) AS updated_at
FROM ({_MON}) m""", "qr"))
def history_append_metrics(spark, sf_dir):
    """Every configured monitor (distinct in the log) logged as an ADDED metric change."""
    res = M.quality_results(measurement_log(spark, sf_dir))
    cfg = res.select("database_name", "schema_name", "table_name",
                     F.col("monitor_name").alias("metric_name"), "column_name").distinct()
    rows = H.metric_change_rows(cfg, "ADDED", updated_by="tessera", updated_at=AS_OF)
    return append_and_read(rows, "metric_history")


_PATH_SQL = "contact_database || '.' || contact_schema || '.\"' || contact_name || '\"'"


@register("contact_changes", with_ctes(f"""
SELECT p.object_database AS database_name, p.object_schema AS schema_name,
  p.object_name AS table_name, p.contact_purpose AS purpose,
  c.path AS old_contact, p.path AS new_contact
FROM (SELECT *, {_PATH_SQL} AS path FROM refs WHERE object_deleted IS NOT NULL) p
LEFT JOIN (SELECT object_database, object_schema, object_name, contact_purpose, max({_PATH_SQL}) AS path
           FROM refs WHERE object_deleted IS NULL
           GROUP BY object_database, object_schema, object_name, contact_purpose) c
  ON p.object_database = c.object_database AND p.object_schema = c.object_schema
 AND p.object_name = c.object_name AND p.contact_purpose = c.contact_purpose""", "refs"))
def contact_changes(spark, sf_dir):
    """Requested assignments (here: the deleted references re-requested) paired with the
    current live contact of the same object and purpose (the true BEFORE)."""
    refs = contact_refs(spark, sf_dir)
    requests = refs.filter(F.col("object_deleted").isNotNull()).select(
        F.col("object_database").alias("database_name"), F.col("object_schema").alias("schema_name"),
        F.col("object_name").alias("table_name"), F.col("contact_purpose").alias("purpose"),
        contact_path().alias("new_contact"))
    return contact_change_requests(refs, requests)


@register("history_append_contacts", with_ctes(f"""
SELECT database_name, schema_name, 'CONTACT_' || purpose AS object_type, table_name AS object_name,
  CAST(NULL AS VARCHAR) AS column_name,
  CASE WHEN old_contact IS NULL OR old_contact IN ('None', '') THEN NULL ELSE old_contact END
    AS before_description,
  CASE WHEN new_contact IS NULL OR new_contact IN ('None', '') THEN NULL ELSE new_contact END
    AS after_description,
  CAST(NULL AS VARCHAR) AS sql_executed, 'tessera' AS updated_by,
  CAST(TIMESTAMP '{AS_OF}' AS TIMESTAMP) AS updated_at
FROM (SELECT p.object_database AS database_name, p.object_schema AS schema_name,
        p.object_name AS table_name, p.contact_purpose AS purpose,
        c.path AS old_contact, p.path AS new_contact
      FROM (SELECT *, {_PATH_SQL} AS path FROM refs WHERE object_deleted IS NOT NULL) p
      LEFT JOIN (SELECT object_database, object_schema, object_name, contact_purpose,
                   max({_PATH_SQL}) AS path
                 FROM refs WHERE object_deleted IS NULL
                 GROUP BY object_database, object_schema, object_name, contact_purpose) c
        ON p.object_database = c.object_database AND p.object_schema = c.object_schema
       AND p.object_name = c.object_name AND p.contact_purpose = c.contact_purpose) s
WHERE new_contact IS NULL OR new_contact <> ''""", "refs"))
def history_append_contacts(spark, sf_dir):
    rows = H.contact_change_rows(contact_changes(spark, sf_dir), updated_by="tessera",
                                 updated_at=AS_OF)
    return append_and_read(rows, "contact_history")


_MONITOR_SCHEMA = T.StructType([
    T.StructField("database_name", T.StringType()), T.StructField("schema_name", T.StringType()),
    T.StructField("table_name", T.StringType()), T.StructField("column_name", T.StringType()),
    T.StructField("monitor_type", T.StringType()), T.StructField("last_check", T.TimestampNTZType()),
    T.StructField("last_status", T.StringType()), T.StructField("configured_at", T.TimestampNTZType()),
    T.StructField("first_seen", T.TimestampNTZType()),
])


@register("export_csv_roundtrip", with_ctes(MONITOR_SQL, "qres"))
def export_csv_roundtrip(spark, sf_dir):
    """Monitor summary -> CSV with header -> read back with the declared schema."""
    path = scratch_path(spark, "exports", unique_name("quality_monitors"))
    export_csv(monitors(spark, sf_dir), path)
    return read_csv(spark, path, _MONITOR_SCHEMA)


def _unit_sql(m: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_UNITS.items())
    return f"CASE {m} {whens} ELSE 'count' END"


_RESULTS_OUT = ("monitor_name, database_name, schema_name, table_name, column_name, metric_value, "
                "metric_unit, threshold_min, threshold_max, status, measurement_time, sql_executed")


@register("results_append", f"""
WITH thresh AS ({THRESH}), m AS ({plan_sql(SUITE, rounded=True)})
SELECT {_RESULTS_OUT} FROM (
  SELECT m.metric_name AS monitor_name, 'TESTDATA' AS database_name, 'PUBLIC' AS schema_name,
    m.table_name, m.column_name, m.value AS metric_value, {_unit_sql('m.metric_name')} AS metric_unit,
    t.threshold_min, t.threshold_max,
    CASE WHEN m.value IS NULL THEN 'UNKNOWN'
         WHEN t.threshold_min IS NULL AND t.threshold_max IS NULL THEN 'MEASURED'
         WHEN (t.threshold_min IS NULL OR m.value >= t.threshold_min)
          AND (t.threshold_max IS NULL OR m.value <= t.threshold_max) THEN 'PASS'
         ELSE 'FAIL' END AS status,
    CAST(TIMESTAMP '{AS_OF}' AS TIMESTAMP) AS measurement_time,
    'ALTER TABLE ' || {sql_fq("'TESTDATA'", "'PUBLIC'", 'm.table_name')} ||
      ' ADD DATA METRIC FUNCTION {METRIC_NAMESPACE}.' || m.metric_name || ' ON (' ||
      coalesce({sql_quote('m.column_name')}, '') || ');' AS sql_executed
  FROM m LEFT JOIN thresh t ON m.metric_name = t.metric_name) s""")
def results_append(spark, sf_dir):
    """Measure the suite, judge it against the threshold policy and append the results
    table (partitioned by measurement date so time-range reads prune partitions)."""
    long = run_plan(spark, sf_dir, SUITE, rounded=True)
    units = F.create_map(*[x for k, v in METRIC_UNITS.items() for x in (F.lit(k), F.lit(v))])
    res = long.select(
        F.col("metric_name").alias("monitor_name"), F.lit("TESTDATA").alias("database_name"),
        F.lit("PUBLIC").alias("schema_name"), "table_name", "column_name",
        F.col("value").alias("metric_value"),
        F.coalesce(units[F.col("metric_name")], F.lit("count")).alias("metric_unit"),
        F.lit(AS_OF).cast("timestamp").alias("measurement_time"))
    res = M.threshold_status(res, thresholds(spark))
    res = res.withColumn("sql_executed", metric_statement(
        "database_name", "schema_name", "table_name", "monitor_name", "column_name"))
    # ids: a content hash (no autoincrement, no global ordering; a re-run gets the same ids)
    res = with_hash_id(res, "result_id", ["monitor_name", "database_name", "schema_name", "table_name",
                                          "column_name", "measurement_time"])
    res = res.withColumn("record_inserted_at", F.col("measurement_time"))
    # a run's results are spread over several tasks by table; the run (date + run id) is written idempotently, so a re-run replaces, not duplicates
    res = (res.withColumn("measurement_date", F.to_date("measurement_time"))
              .withColumn("run_id", F.date_format("measurement_time", "yyyyMMddHHmmss"))
              .repartition("measurement_date", "run_id", F.pmod(F.xxhash64("table_name"), F.lit(16))))
    path = scratch_path(spark, "quality_results", unique_name("quality_results"))
    write_run(res, path, ["measurement_date", "run_id"])
    out = spark.read.parquet(path)
    return out.select(*[c.strip() for c in _RESULTS_OUT.split(",")])


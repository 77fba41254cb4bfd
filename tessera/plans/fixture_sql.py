"""Oracle-side (DuckDB) definitions of the derived inputs in ``tessera.sources.fixtures``.

Written separately in DuckDB SQL; the Spark side builds the same tables with its own
Spark SQL projections. Each constant is the body of a CTE.
"""

QR = """
SELECT event_id AS result_id,
  CASE event_type WHEN 'view' THEN 'ROW_COUNT' WHEN 'click' THEN 'NULL_COUNT'
       WHEN 'purchase' THEN 'UNIQUE_COUNT' WHEN 'signup' THEN 'FRESHNESS'
       ELSE 'DUPLICATE_COUNT' END AS metric_name,
  concat('DB', CAST(user_id % 3 AS VARCHAR)) AS table_database,
  concat('S', CAST(user_id % 2 AS VARCHAR)) AS table_schema,
  concat('T', CAST(user_id % 50 AS VARCHAR)) AS table_name,
  CASE WHEN event_type = 'view' THEN NULL ELSE 'COLUMN' END AS arg_type,
  CASE WHEN event_type = 'view' THEN NULL
       ELSE concat('C', CAST(event_id % 4 AS VARCHAR)) END AS arg_name,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
  ts AS measurement_time
FROM events
"""

HIST = """
SELECT event_id AS history_id,
  concat('DB', CAST(user_id % 3 AS VARCHAR)) AS database_name,
  concat('S', CAST(user_id % 2 AS VARCHAR)) AS schema_name,
  CASE event_id % 7 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'COLUMN'
       WHEN 3 THEN 'DMF_ROW_COUNT' WHEN 4 THEN 'DMF_NULL_COUNT_COLUMN'
       WHEN 5 THEN 'CONTACT_STEWARD' ELSE 'CONTACT_SUPPORT' END AS object_type,
  concat('T', CAST(user_id % 50 AS VARCHAR)) AS object_name,
  CASE WHEN event_id % 7 IN (2, 4)
       THEN concat('C', CAST(event_id % 4 AS VARCHAR)) END AS column_name,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('old ', event_type) END AS before_description,
  concat('new ', event_type) AS after_description,
  concat('user', CAST(user_id % 7 AS VARCHAR)) AS updated_by,
  ts AS updated_at
FROM events
"""

OBJS = """
SELECT CASE WHEN p_partkey % 23 = 0 THEN 'SYSTEM' WHEN p_partkey % 29 = 0 THEN concat('X', CAST(p_partkey % 4 AS VARCHAR))
       ELSE concat('DB', CAST(p_partkey % 3 AS VARCHAR)) END AS table_catalog,
  CASE WHEN p_partkey % 31 = 0 THEN 'INFORMATION_SCHEMA'
       ELSE concat('S', CAST(p_partkey % 2 AS VARCHAR)) END AS table_schema,
  concat('T', CAST(p_partkey AS VARCHAR)) AS table_name,
  CASE WHEN p_partkey % 5 = 0 THEN 'VIEW' WHEN p_partkey % 11 = 0 THEN 'EXTERNAL TABLE'
       ELSE 'BASE TABLE' END AS table_type,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE p_name END AS comment,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'APPLICATION'
       ELSE 'ROLE' END AS owner_role_type,
  CASE WHEN p_partkey % 9 = 0 THEN 'yes' ELSE 'no' END AS is_secure
FROM part
"""

REFS = """
SELECT CASE WHEN c_custkey % 37 <> 0 THEN c_name END AS contact_name, 'GOV' AS contact_database, 'PUBLIC' AS contact_schema,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'STEWARD' WHEN 'MACHINERY' THEN 'SUPPORT'
       WHEN 'HOUSEHOLD' THEN 'ACCESS_APPROVAL' ELSE 'GENERAL' END AS contact_purpose,
  concat('DB', CAST(c_custkey % 100 % 3 AS VARCHAR)) AS object_database,
  concat('S', CAST(c_custkey % 100 % 2 AS VARCHAR)) AS object_schema,
  concat('T', CAST(c_custkey % 100 AS VARCHAR)) AS object_name,
  CASE WHEN c_acctbal < 0 THEN c_custkey END AS object_deleted
FROM customer
"""

DOCS_L = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

COLS = """
SELECT concat('DB', CAST(o_custkey % 3 AS VARCHAR)) AS table_catalog,
  concat('S', CAST(o_custkey % 2 AS VARCHAR)) AS table_schema,
  concat('T', CAST(o_custkey AS VARCHAR)) AS table_name,
  concat(CASE o_orderkey % 7 WHEN 0 THEN 'AMOUNT_' WHEN 1 THEN 'NAME_' WHEN 2 THEN 'CREATED_AT_'
         WHEN 3 THEN 'SHIP_DATE_' WHEN 4 THEN 'IS_ACTIVE_' WHEN 5 THEN 'UPDATED_TS_'
         ELSE 'SENTIMENT_' END, CAST(o_orderkey AS VARCHAR)) AS column_name,
  CASE o_orderkey % 7 WHEN 0 THEN 'NUMBER' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'TIMESTAMP_NTZ'
       WHEN 3 THEN 'DATE' WHEN 4 THEN 'BOOLEAN' WHEN 5 THEN 'TIMESTAMP_LTZ' ELSE 'FLOAT' END
    AS data_type,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN ' '
       ELSE concat(o_orderpriority, ' order') END AS comment,
  o_orderkey AS ordinal_position
FROM orders
"""

THRESH = """
SELECT * FROM (VALUES ('NULL_COUNT', 0.0::DOUBLE, 100.0::DOUBLE),
                      ('UNIQUE_COUNT', 20.0::DOUBLE, NULL::DOUBLE),
                      ('FRESHNESS', NULL::DOUBLE, 50.0::DOUBLE))
  AS t(metric_name, threshold_min, threshold_max)
"""

# quality results with the reference's column shaping plus PASS/FAIL from thresholds
QRES = """
SELECT q.result_id, q.metric_name AS monitor_name, q.table_database AS database_name,
  q.table_schema AS schema_name, q.table_name,
  CASE WHEN q.arg_type = 'COLUMN' AND q.arg_name IS NOT NULL THEN q.arg_name END AS column_name,
  q.value AS metric_value, t.threshold_min, t.threshold_max,
  CASE WHEN q.value IS NULL THEN 'UNKNOWN'
       WHEN t.threshold_min IS NULL AND t.threshold_max IS NULL THEN 'MEASURED'
       WHEN (t.threshold_min IS NULL OR q.value >= t.threshold_min)
        AND (t.threshold_max IS NULL OR q.value <= t.threshold_max) THEN 'PASS'
       ELSE 'FAIL' END AS status,
  q.measurement_time
FROM qr q LEFT JOIN thresh t ON q.metric_name = t.metric_name
"""


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named CTEs (dependencies first)."""
    defs = {"qr": QR, "hist": HIST, "objs": OBJS, "refs": REFS, "docs_l": DOCS_L,
            "cols": COLS, "thresh": THRESH, "qres": QRES}
    needed: list[str] = []
    for n in names:
        if n == "qres":
            for dep in ("qr", "thresh"):
                if dep not in needed:
                    needed.append(dep)
        if n not in needed:
            needed.append(n)
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in needed)
    return f"WITH {ctes}\n{body}"

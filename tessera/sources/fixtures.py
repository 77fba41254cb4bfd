"""Derived inputs: the engine's log/metadata tables built from the given test tables.

The engine's own tables (measurement log, audit log, catalog snapshots, contact
references) have no counterpart in the test data, so they are derived from it with
plain projections. They grow with the scale factor like the tables they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.config import config_frame
from tessera.sources.tables import read_table


def measurement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native-style measurement log: one row per measured value (from ``events``).

    Argument types/names are arrays as in the warehouse log (empty for table metrics).
    """
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS result_id",
        "CASE event_type WHEN 'view' THEN 'ROW_COUNT' WHEN 'click' THEN 'NULL_COUNT' "
        "WHEN 'purchase' THEN 'UNIQUE_COUNT' WHEN 'signup' THEN 'FRESHNESS' "
        "ELSE 'DUPLICATE_COUNT' END AS metric_name",
        "concat('DB', CAST(user_id % 3 AS STRING)) AS table_database",
        "concat('S', CAST(user_id % 2 AS STRING)) AS table_schema",
        "concat('T', CAST(user_id % 50 AS STRING)) AS table_name",
        "CASE WHEN event_type = 'view' THEN CAST(array() AS array<string>) "
        "ELSE array('COLUMN') END AS argument_types",
        "CASE WHEN event_type = 'view' THEN CAST(array() AS array<string>) "
        "ELSE array(concat('C', CAST(event_id % 4 AS STRING))) END AS argument_names",
        "CASE WHEN event_id % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE value END AS value",
        "ts AS measurement_time",
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description/metric/contact change history (from ``events``)."""
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS history_id",
        "concat('DB', CAST(user_id % 3 AS STRING)) AS database_name",
        "concat('S', CAST(user_id % 2 AS STRING)) AS schema_name",
        "CASE event_id % 7 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'COLUMN' "
        "WHEN 3 THEN 'DMF_ROW_COUNT' WHEN 4 THEN 'DMF_NULL_COUNT_COLUMN' "
        "WHEN 5 THEN 'CONTACT_STEWARD' ELSE 'CONTACT_SUPPORT' END AS object_type",
        "concat('T', CAST(user_id % 50 AS STRING)) AS object_name",
        "CASE WHEN event_id % 7 IN (2, 4) THEN concat('C', CAST(event_id % 4 AS STRING)) END "
        "AS column_name",
        "CASE WHEN event_id % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('old ', event_type) END "
        "AS before_description",
        "concat('new ', event_type) AS after_description",
        "concat('user', CAST(user_id % 7 AS STRING)) AS updated_by",
        "ts AS updated_at",
    )


def account_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog objects / account tables (from ``part``): blank, empty and NULL comments."""
    return read_table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 23 = 0 THEN 'SYSTEM' WHEN p_partkey % 29 = 0 "
        "THEN concat('X', CAST(p_partkey % 4 AS STRING)) "
        "ELSE concat('DB', CAST(p_partkey % 3 AS STRING)) END AS table_catalog",
        "CASE WHEN p_partkey % 31 = 0 THEN 'INFORMATION_SCHEMA' "
        "ELSE concat('S', CAST(p_partkey % 2 AS STRING)) END AS table_schema",
        "concat('T', CAST(p_partkey AS STRING)) AS table_name",
        "CASE WHEN p_partkey % 5 = 0 THEN 'VIEW' WHEN p_partkey % 11 = 0 THEN 'EXTERNAL TABLE' "
        "ELSE 'BASE TABLE' END AS table_type",
        "CASE p_partkey % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 2 THEN '  ' "
        "ELSE p_name END AS comment",
        "CASE WHEN p_partkey % 13 = 0 THEN CAST(NULL AS STRING) WHEN p_partkey % 17 = 0 "
        "THEN 'APPLICATION' ELSE 'ROLE' END AS owner_role_type",
        "CASE WHEN p_partkey % 9 = 0 THEN 'yes' ELSE 'no' END AS is_secure",
    )


def contact_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact references (from ``customer``): several per purpose, deleted ones."""
    return read_table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 37 <> 0 THEN c_name END AS contact_name", "'GOV' AS contact_database", "'PUBLIC' AS contact_schema",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'STEWARD' WHEN 'MACHINERY' THEN 'SUPPORT' "
        "WHEN 'HOUSEHOLD' THEN 'ACCESS_APPROVAL' ELSE 'GENERAL' END AS contact_purpose",
        "concat('DB', CAST(c_custkey % 100 % 3 AS STRING)) AS object_database",
        "concat('S', CAST(c_custkey % 100 % 2 AS STRING)) AS object_schema",
        "concat('T', CAST(c_custkey % 100 AS STRING)) AS object_name",
        "CASE WHEN c_acctbal < 0 THEN c_custkey END AS object_deleted",
    )


def labeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` left-joined with ``labels``: real NULLs for the NULL metrics."""
    d = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column catalog (from ``orders``): one column per order, tables keyed by customer.

    Names carry the words the freshness heuristic looks for (and SENTIMENT, which holds
    TIME without being temporal); comments cover NULL, '', 'null' and blank.
    """
    return read_table(spark, sf_dir, "orders").selectExpr(
        "concat('DB', CAST(o_custkey % 3 AS STRING)) AS table_catalog",
        "concat('S', CAST(o_custkey % 2 AS STRING)) AS table_schema",
        "concat('T', CAST(o_custkey AS STRING)) AS table_name",
        "concat(CASE o_orderkey % 7 WHEN 0 THEN 'AMOUNT_' WHEN 1 THEN 'NAME_' "
        "WHEN 2 THEN 'CREATED_AT_' WHEN 3 THEN 'SHIP_DATE_' WHEN 4 THEN 'IS_ACTIVE_' "
        "WHEN 5 THEN 'UPDATED_TS_' ELSE 'SENTIMENT_' END, CAST(o_orderkey AS STRING)) AS column_name",
        "CASE o_orderkey % 7 WHEN 0 THEN 'NUMBER' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'TIMESTAMP_NTZ' "
        "WHEN 3 THEN 'DATE' WHEN 4 THEN 'BOOLEAN' WHEN 5 THEN 'TIMESTAMP_LTZ' ELSE 'FLOAT' END "
        "AS data_type",
        "CASE o_orderkey % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 2 THEN 'null' "
        "WHEN 3 THEN ' ' ELSE concat(o_orderpriority, ' order') END AS comment",
        "o_orderkey AS ordinal_position",
    )


THRESHOLD_ROWS = [("NULL_COUNT", 0.0, 100.0), ("UNIQUE_COUNT", 20.0, None), ("FRESHNESS", None, 50.0)]


def thresholds(spark: SparkSession) -> DataFrame:
    """Threshold policy per metric (a configuration input, not data)."""
    return config_frame(spark, THRESHOLD_ROWS,
                        "metric_name string, threshold_min double, threshold_max double")

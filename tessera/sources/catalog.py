"""Catalog snapshots from a Spark session (thin collectors over catalog metadata).

Listing a catalog is metadata work on the driver by nature; the snapshot is then a
DataFrame and every operator over it runs on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.sources.config import config_frame

OBJECT_SCHEMA = T.StructType([
    T.StructField("table_catalog", T.StringType()), T.StructField("table_schema", T.StringType()),
    T.StructField("table_name", T.StringType()), T.StructField("table_type", T.StringType()),
    T.StructField("comment", T.StringType()), T.StructField("is_secure", T.StringType()),
])
COLUMN_SCHEMA = T.StructType([
    T.StructField("table_catalog", T.StringType()), T.StructField("table_schema", T.StringType()),
    T.StructField("table_name", T.StringType()), T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()), T.StructField("comment", T.StringType()),
    T.StructField("ordinal_position", T.LongType()),
])


def type_name(dt: T.DataType) -> str:
    """Catalog-style type name: Spark's SQL name, upper-cased (BIGINT, TIMESTAMP_NTZ, ...)."""
    return dt.simpleString().upper()


def _field_rows(df: DataFrame, table: str, database: str, schema: str) -> list[tuple]:
    return [(database, schema, table, f.name, type_name(f.dataType),
             (f.metadata or {}).get("comment"), i + 1) for i, f in enumerate(df.schema.fields)]


def schema_columns(df: DataFrame, table: str, database: str = "", schema: str = "") -> DataFrame:
    """One row per field of ``df`` (ordinal from 1), comments from field metadata."""
    return config_frame(df.sparkSession, _field_rows(df, table, database, schema), COLUMN_SCHEMA)


def schemas_columns(frames: dict[str, DataFrame], database: str = "", schema: str = "") -> DataFrame:
    """The column rows of several frames (``{table: df}``) as one frame."""
    spark = next(iter(frames.values())).sparkSession
    rows = [r for t, df in frames.items() for r in _field_rows(df, t, database, schema)]
    return config_frame(spark, rows, COLUMN_SCHEMA)


def readable(spark: SparkSession, name: str) -> bool:
    """True when the table/view resolves (analysis only; no job runs)."""
    try:
        spark.table(name).schema
        return True
    except Exception:
        return False


def session_objects(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Snapshot of tables and views in the session catalog; unreadable views skipped."""
    rows = []
    dbs = [database] if database else [d.name for d in spark.catalog.listDatabases()]
    for db in dbs:
        for t in spark.catalog.listTables(db):
            if t.isTemporary:
                continue
            ttype = "VIEW" if t.tableType == "VIEW" else "BASE TABLE"
            fq = f"`{db}`.`{t.name}`"
            if ttype == "VIEW" and not readable(spark, fq):
                continue
            rows.append((t.catalog or "spark_catalog", db, t.name, ttype, t.description, "no"))
    return spark.createDataFrame(rows, OBJECT_SCHEMA)


def _catalog_fields(spark: SparkSession, database: str, table: str) -> list[tuple]:
    return [("spark_catalog", database, table, c.name, c.dataType.upper(), c.description, i + 1)
            for i, c in enumerate(spark.catalog.listColumns(f"`{database}`.`{table}`"))]


def session_columns(spark: SparkSession, database: str, *tables: str) -> DataFrame:
    """The columns of one or more tables of the session catalog, as one frame."""
    return config_frame(spark, [r for t in tables for r in _catalog_fields(spark, database, t)], COLUMN_SCHEMA)

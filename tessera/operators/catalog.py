"""Catalog inventory over metadata snapshots.

Input snapshots use the account-table shape (``table_catalog, table_schema, table_name,
table_type, comment, is_secure``) and the column shape (``table_catalog, table_schema,
table_name, column_name, data_type, comment, ordinal_position``). A snapshot can come
from any catalog; :mod:`tessera.sources.catalog` collects one from the Spark catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import (column_description, has_description, object_description,
                                    search_match)

# Databases that belong to the platform; catalogs with others name them as a parameter.
WAREHOUSE_DATABASE = "SYSTEM"
SYSTEM_DATABASES = (WAREHOUSE_DATABASE, "INFORMATION_SCHEMA")
# System schemas left out of listings, the listed object types, and the flag
# spellings that mark a secure view.
SYSTEM_SCHEMAS = ("INFORMATION_SCHEMA",)
LISTED_TYPES = ("BASE TABLE", "VIEW")
SECURE_FLAGS = ("YES", "TRUE", "Y", "1")


def databases(objects: DataFrame, sort: bool = True, system=SYSTEM_DATABASES) -> DataFrame:
    """Distinct non-system databases, sorted."""
    db = F.col("table_catalog")
    out = (objects.filter(db.isNotNull() & ~db.isin(*system))
           .select(db.alias("database_name")).distinct())
    return out.orderBy("database_name") if sort else out


def schemas(objects: DataFrame, database: str | None = None, sort: bool = True) -> DataFrame:
    """Distinct (database, schema) pairs except the system schema, sorted."""
    df = objects
    if database is not None:          # names compare case-insensitively on both sides
        df = df.filter(F.upper(F.col("table_catalog")) == database.upper())
    out = (df.filter(~F.col("table_schema").isin(*SYSTEM_SCHEMAS))
           .select(F.col("table_catalog").alias("database_name"),
                   F.col("table_schema").alias("schema_name"))
           .distinct())
    return out.orderBy("database_name", "schema_name") if sort else out


def objects_listing(objects: DataFrame, database: str | None = None,
                    schema: str | None = None, sort: bool = True) -> DataFrame:
    """Tables and views with description flag: tables UNION views (secure views dropped),
    sorted by (database, schema, name) -- ``sort=False`` when the listing only feeds a join
    or an aggregate (a global sort there is wasted work)."""
    df = objects
    if database is not None:          # names compare case-insensitively on both sides
        df = df.filter(F.upper(F.col("table_catalog")) == database.upper())
    if schema is not None:
        df = df.filter(F.upper(F.col("table_schema")) == schema.upper())

    def shape(x: DataFrame) -> DataFrame:
        return x.select(
            F.col("table_catalog").alias("database_name"),
            F.col("table_schema").alias("schema_name"),
            F.col("table_name").alias("object_name"),
            F.col("table_type").alias("object_type"),
            object_description(F.col("comment")).alias("current_description"),
            has_description(F.col("comment")).alias("has_description"))

    secure = F.upper(F.coalesce(F.col("is_secure").cast("string"), F.lit(""))).isin(*SECURE_FLAGS)
    listed = (F.col("table_type") == "BASE TABLE") | (F.col("table_type") == "VIEW") & ~secure
    out = (shape(df.filter(listed))
           .filter(F.col("object_name").isNotNull() & (F.col("object_name") != "")))
    return out.orderBy("database_name", "schema_name", "object_name") if sort else out


def columns_listing(columns: DataFrame, sort: bool = True) -> DataFrame:
    """Columns with type, description ('', 'null', 'NULL' -> NULL) and flag, by ordinal
    (``sort=False`` for internal use)."""
    out = columns.select(
        F.col("table_catalog").alias("database_name"),
        F.col("table_schema").alias("schema_name"),
        "table_name", "column_name", "data_type",
        column_description(F.col("comment")).alias("current_description"),
        has_description(column_description(F.col("comment"))).alias("has_description"),
        "ordinal_position",
    )
    return out.orderBy("database_name", "schema_name", "table_name", "ordinal_position") if sort else out


def of_type(listing: DataFrame, object_type: str) -> DataFrame:
    return listing.filter(F.col("object_type") == object_type)


def undocumented(listing: DataFrame) -> DataFrame:
    return listing.filter(F.col("has_description") == "No")


def search(listing: DataFrame, pattern: str, col: str = "object_name", literal: bool = False) -> DataFrame:
    """Case-insensitive regex search on a name (``literal=True`` escapes the pattern)."""
    return listing.filter(search_match(col, pattern, literal))

"""Registered catalog-inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import column_description, has_description, object_description
from tessera.operators import catalog as C
from tessera.plans.base import register
from tessera.plans.fixture_sql import with_ctes
from tessera.sources.fixtures import account_objects, catalog_columns

_SYSTEM_DBS = ", ".join(f"'{d}'" for d in C.SYSTEM_DATABASES)
NONBLANK = "regexp_matches({c}, '[^ \\t\\n\\x0B\\f\\r]')"


def _has(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR NOT {NONBLANK.format(c=c)} THEN 'No' ELSE 'Yes' END"


OBJ_LISTING_SQL = f"""
SELECT table_catalog AS database_name, table_schema AS schema_name, table_name AS object_name,
  table_type AS object_type, nullif(comment, '') AS current_description,
  {_has('comment')} AS has_description
FROM objs
WHERE (table_type = 'BASE TABLE'
       OR (table_type = 'VIEW' AND upper(coalesce(is_secure, '')) NOT IN ('YES', 'TRUE', 'Y', '1')))
  AND table_name IS NOT NULL AND table_name <> ''"""

_COL_DESC = "CASE WHEN comment IN ('', 'null', 'NULL') THEN NULL ELSE comment END"
COL_LISTING_SQL = f"""
SELECT table_catalog AS database_name, table_schema AS schema_name, table_name, column_name,
  data_type, {_COL_DESC} AS current_description, {_has(_COL_DESC)} AS has_description,
  ordinal_position
FROM cols"""


def listing(spark, sf_dir, sort=True):
    return C.objects_listing(account_objects(spark, sf_dir), sort=sort)


def col_listing(spark, sf_dir, sort=True):
    return C.columns_listing(catalog_columns(spark, sf_dir), sort=sort)


@register("inventory_databases", with_ctes(f"""
SELECT DISTINCT table_catalog AS database_name FROM objs
WHERE table_catalog IS NOT NULL AND table_catalog NOT IN ({_SYSTEM_DBS})""", "objs"))
def inventory_databases(spark, sf_dir):
    return C.databases(account_objects(spark, sf_dir))


@register("inventory_schemas", with_ctes("""
SELECT DISTINCT table_catalog AS database_name, table_schema AS schema_name FROM objs
WHERE table_schema NOT IN ('INFORMATION_SCHEMA')""", "objs"))
def inventory_schemas(spark, sf_dir):
    return C.schemas(account_objects(spark, sf_dir))


@register("inventory_objects", with_ctes(OBJ_LISTING_SQL, "objs"))
def inventory_objects(spark, sf_dir):
    return listing(spark, sf_dir)


@register("inventory_columns", with_ctes(COL_LISTING_SQL, "cols"))
def inventory_columns(spark, sf_dir):
    return col_listing(spark, sf_dir)


@register("filter_objects", with_ctes(f"SELECT * FROM ({OBJ_LISTING_SQL}) o WHERE object_type = 'BASE TABLE'",
                                      "objs"))
def filter_objects(spark, sf_dir):
    return C.of_type(listing(spark, sf_dir), "BASE TABLE")


@register("undocumented_objects", with_ctes(
    f"SELECT * FROM ({OBJ_LISTING_SQL}) o WHERE has_description = 'No'", "objs"))
def undocumented_objects(spark, sf_dir):
    return C.undocumented(listing(spark, sf_dir))


@register("undocumented_columns", with_ctes(
    f"SELECT * FROM ({COL_LISTING_SQL}) c WHERE has_description = 'No'", "cols"))
def undocumented_columns(spark, sf_dir):
    return C.undocumented(col_listing(spark, sf_dir))


SEARCH_PATTERN = "^t1.*5$"


@register("search_objects", with_ctes(
    f"SELECT * FROM ({OBJ_LISTING_SQL}) o WHERE coalesce(regexp_matches(object_name, '(?i){SEARCH_PATTERN}'), false)",
    "objs"))
def search_objects(spark, sf_dir):
    return C.search(listing(spark, sf_dir), SEARCH_PATTERN)


@register("description_flags", with_ctes(f"""
SELECT table_name, comment AS raw_comment,
  nullif(comment, '') AS object_description, {_has('comment')} AS object_has_description,
  CASE WHEN comment IN ('', 'null', 'NULL') THEN NULL ELSE comment END AS column_description,
  {_has(_COL_DESC)} AS column_has_description
FROM objs""", "objs"))
def description_flags(spark, sf_dir):
    o = account_objects(spark, sf_dir)
    c = F.col("comment")
    return o.select("table_name", c.alias("raw_comment"),
                    object_description(c).alias("object_description"),
                    has_description(c).alias("object_has_description"),
                    column_description(c).alias("column_description"),
                    has_description(column_description(c)).alias("column_has_description"))

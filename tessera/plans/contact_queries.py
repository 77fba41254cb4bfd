"""Registered contact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import contacts as K
from tessera.operators import monitor as M
from tessera.plans.base import register
from tessera.plans.catalog_queries import OBJ_LISTING_SQL, listing
from tessera.plans.fixture_sql import with_ctes
from tessera.sources.fixtures import contact_refs, measurement_log

_PATH = "contact_database || '.' || contact_schema || '.\"' || contact_name || '\"'"
_COMPLETE = ("contact_name IS NOT NULL AND contact_name <> '' AND contact_database IS NOT NULL "
             "AND contact_database <> '' AND contact_schema IS NOT NULL AND contact_schema <> ''")


@register("contacts_qualified", with_ctes(f"""
SELECT 'None' AS contact UNION ALL
SELECT DISTINCT {_PATH} AS contact FROM refs WHERE {_COMPLETE}""", "refs"))
def contacts_qualified(spark, sf_dir):
    return K.qualified_contacts(contact_refs(spark, sf_dir))


@register("contacts_pivot", with_ctes(f"""
SELECT o.database_name, o.schema_name, o.object_name, o.object_type,
  coalesce(p.steward, 'Not assigned') AS steward, coalesce(p.support, 'Not assigned') AS support,
  coalesce(p.access_approval, 'Not assigned') AS access_approval
FROM ({OBJ_LISTING_SQL}) o
LEFT JOIN (SELECT object_database, object_schema, object_name,
             max(CASE WHEN contact_purpose = 'STEWARD' THEN {_PATH} END) AS steward,
             max(CASE WHEN contact_purpose = 'SUPPORT' THEN {_PATH} END) AS support,
             max(CASE WHEN contact_purpose = 'ACCESS_APPROVAL' THEN {_PATH} END) AS access_approval
           FROM refs WHERE object_deleted IS NULL AND {_COMPLETE}
           GROUP BY object_database, object_schema, object_name) p
  ON o.database_name = p.object_database AND o.schema_name = p.object_schema
 AND o.object_name = p.object_name""", "objs", "refs"))
def contacts_pivot(spark, sf_dir):
    objs = listing(spark, sf_dir, sort=False).select("database_name", "schema_name", "object_name", "object_type")
    return K.contacts_pivot(objs, contact_refs(spark, sf_dir))


@register("contacts_preview", with_ctes("""
SELECT * FROM refs WHERE object_deleted IS NULL
ORDER BY object_database, object_schema, object_name, contact_purpose, contact_name LIMIT 10""", "refs"))
def contacts_preview(spark, sf_dir):
    return K.preview(contact_refs(spark, sf_dir), 10)


@register("tables_without_contacts", with_ctes(f"""
SELECT * FROM ({OBJ_LISTING_SQL}) o WHERE NOT EXISTS (
  SELECT 1 FROM refs r WHERE r.object_deleted IS NULL AND r.object_database = o.database_name
    AND r.object_schema = o.schema_name AND r.object_name = o.object_name)""", "objs", "refs"))
def tables_without_contacts(spark, sf_dir):
    live = K.live(contact_refs(spark, sf_dir)).select(
        F.col("object_database").alias("database_name"), F.col("object_schema").alias("schema_name"),
        "object_name").distinct()
    return listing(spark, sf_dir, sort=False).join(live, ["database_name", "schema_name", "object_name"], "left_anti")


@register("unmonitored_objects", with_ctes(f"""
SELECT * FROM ({OBJ_LISTING_SQL}) o WHERE NOT EXISTS (
  SELECT 1 FROM qr WHERE qr.table_database = o.database_name AND qr.table_schema = o.schema_name
    AND qr.table_name = o.object_name)""", "objs", "qr"))
def unmonitored_objects(spark, sf_dir):
    mon = M.quality_results(measurement_log(spark, sf_dir)).select(
        "database_name", "schema_name", F.col("table_name").alias("object_name")).distinct()
    return listing(spark, sf_dir, sort=False).join(mon, ["database_name", "schema_name", "object_name"], "left_anti")


@register("monitored_objects", with_ctes(f"""
SELECT * FROM ({OBJ_LISTING_SQL}) o WHERE EXISTS (
  SELECT 1 FROM qr WHERE qr.table_database = o.database_name AND qr.table_schema = o.schema_name
    AND qr.table_name = o.object_name)""", "objs", "qr"))
def monitored_objects(spark, sf_dir):
    mon = M.quality_results(measurement_log(spark, sf_dir)).select(
        "database_name", "schema_name", F.col("table_name").alias("object_name")).distinct()
    return listing(spark, sf_dir, sort=False).join(mon, ["database_name", "schema_name", "object_name"], "left_semi")

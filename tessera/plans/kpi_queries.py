"""Registered KPI queries (A9-A14) and dashboard number formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import kpi as KP
from tessera.operators.catalog import SYSTEM_DATABASES, WAREHOUSE_DATABASE
from tessera.operators.contacts import live
from tessera.plans.base import register
from tessera.plans.fixture_sql import with_ctes
from tessera.plans.monitor_queries import results
from tessera.sources.fixtures import account_objects, contact_refs, measurement_log

_SYSTEM_DBS = ", ".join(f"'{d}'" for d in SYSTEM_DATABASES)
_KPI_WHERE = (f"table_catalog NOT IN ('{WAREHOUSE_DATABASE}') AND table_catalog IS NOT NULL "
              "AND table_type ILIKE '%table%' AND owner_role_type <> 'APPLICATION'")
_NONBLANK = "regexp_matches(comment, '[^ \\t\\n\\x0B\\f\\r]')"
_DOC = f"""
SELECT count(*) AS tables, count(comment) AS tables_with_descriptions,
  count(*) FILTER (WHERE comment IS NOT NULL AND {_NONBLANK}) AS tables_with_nonblank_descriptions,
  CASE WHEN count(*) > 0 THEN round(count(comment)::DOUBLE / count(*) * 100, 1) ELSE 0.0::DOUBLE END
    AS description_percentage
FROM objs WHERE {_KPI_WHERE}"""


@register("kpi_documentation", with_ctes(_DOC, "objs"))
def kpi_documentation(spark, sf_dir):
    return KP.documentation_kpi(account_objects(spark, sf_dir))


@register("kpi_monitors", with_ctes(
    "SELECT count(DISTINCT table_database || table_schema || metric_name) AS dmf_count FROM qr", "qr"))
def kpi_monitors(spark, sf_dir):
    return KP.monitors_kpi(measurement_log(spark, sf_dir))


@register("kpi_monitors_exact", with_ctes("""
SELECT count(*) AS monitors FROM (SELECT DISTINCT database_name, schema_name, table_name, column_name,
  monitor_name FROM qres) d""", "qres"))
def kpi_monitors_exact(spark, sf_dir):
    return KP.monitors_exact(results(spark, sf_dir))


_SCH = "(SELECT DISTINCT table_catalog AS d, table_schema AS s FROM objs WHERE table_schema NOT IN ('INFORMATION_SCHEMA'))"
_DBS = ("(SELECT DISTINCT table_catalog AS d FROM objs WHERE table_catalog IS NOT NULL "
        f"AND table_catalog NOT IN ({_SYSTEM_DBS}))")
_FIRST = f"(SELECT d FROM {_DBS} x ORDER BY d LIMIT 3)"
_EST = f"""CAST(CASE WHEN (SELECT count(*) FROM {_FIRST} f) > 0
  THEN floor((SELECT count(*) FROM {_SCH} s WHERE d IN (SELECT d FROM {_FIRST} f2))
             * ((SELECT count(*) FROM {_DBS} a)::DOUBLE / (SELECT count(*) FROM {_FIRST} f3)))
  ELSE (SELECT count(*) FROM {_SCH} s WHERE d IN (SELECT d FROM {_FIRST} f4)) END AS BIGINT)"""


@register("kpi_schemas", with_ctes(f"SELECT count(*) AS schemas FROM {_SCH} s", "objs"))
def kpi_schemas(spark, sf_dir):
    return KP.schemas_exact(account_objects(spark, sf_dir))


@register("kpi_schemas_estimate", with_ctes(f"SELECT {_EST} AS schemas_estimate", "objs"))
def kpi_schemas_estimate(spark, sf_dir):
    return KP.schemas_estimate(account_objects(spark, sf_dir))


_KPI_T = f"(SELECT table_catalog, table_schema, table_name FROM objs WHERE {_KPI_WHERE})"


@register("kpi_coverage", with_ctes(f"""
SELECT (SELECT count(*) FROM {_KPI_T} t WHERE EXISTS (SELECT 1 FROM qr WHERE qr.table_database = t.table_catalog
          AND qr.table_schema = t.table_schema AND qr.table_name = t.table_name)) AS tables_with_monitors,
       (SELECT count(*) FROM {_KPI_T} t WHERE EXISTS (SELECT 1 FROM refs r WHERE r.object_deleted IS NULL
          AND r.object_database = t.table_catalog AND r.object_schema = t.table_schema
          AND r.object_name = t.table_name)) AS tables_with_contacts""", "objs", "qr", "refs"))
def kpi_coverage(spark, sf_dir):
    mon = measurement_log(spark, sf_dir).select(
        F.col("table_database").alias("table_catalog"), F.col("table_schema"), "table_name")
    con = live(contact_refs(spark, sf_dir)).select(
        F.col("object_database").alias("table_catalog"), F.col("object_schema").alias("table_schema"),
        F.col("object_name").alias("table_name"))
    return KP.coverage(account_objects(spark, sf_dir), mon, con)


@register("kpi_overview", with_ctes(f"""
SELECT databases, schemas, tables, tables_with_descriptions, dmf_count, contacts_count,
  description_percentage, least(dmf_count, tables) AS tables_with_dmfs,
  least(contacts_count, tables) AS tables_with_contacts
FROM (SELECT (SELECT count(*) FROM {_DBS} a) AS databases, (SELECT count(*) FROM {_SCH} s) AS schemas,
        d.tables, d.tables_with_descriptions, d.description_percentage,
        (SELECT count(DISTINCT table_database || table_schema || metric_name) FROM qr) AS dmf_count,
        (SELECT count(*) FROM (SELECT DISTINCT contact_database, contact_schema, contact_name FROM refs) c)
          AS contacts_count
      FROM ({_DOC}) d) k""", "objs", "qr", "refs"))
def kpi_overview(spark, sf_dir):
    objs = account_objects(spark, sf_dir)
    return KP.overview(objs, objs, measurement_log(spark, sf_dir), contact_refs(spark, sf_dir))


@register("kpi_display", with_ctes(f"""
SELECT format('{{:,}}', tables) AS tables_text,
  format('{{:,}}', tables_with_descriptions) AS documented_text,
  printf('%.1f%%', description_percentage) AS description_percentage_text
FROM ({_DOC}) d""", "objs"))
def kpi_display(spark, sf_dir):
    """Dashboard formatting: thousands separators and one-decimal percentages."""
    from tessera.functions.text import percent_1, thousands
    d = KP.documentation_kpi(account_objects(spark, sf_dir))
    return d.select(thousands("tables").alias("tables_text"),
                    thousands("tables_with_descriptions").alias("documented_text"),
                    percent_1("description_percentage").alias("description_percentage_text"))

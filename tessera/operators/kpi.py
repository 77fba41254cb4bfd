"""Governance KPIs (A9-A14): one-row aggregates over catalog snapshots and logs.

Several scalar aggregates are combined into one row with a long union + pivot (one
tiny aggregate) rather than joins of single-row frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_blank
from tessera.operators.catalog import (SYSTEM_DATABASES, SYSTEM_SCHEMAS, WAREHOUSE_DATABASE, databases,
                                       schemas)
from tessera.operators.scalars import combine, combine_rows

SCHEMA_SAMPLE_DATABASES = 3


def kpi_tables(account_tables: DataFrame, system=(WAREHOUSE_DATABASE,)) -> DataFrame:
    """Account tables the documentation KPI counts (NULL role types drop out of ``<>``)."""
    return account_tables.filter(
        ~F.col("table_catalog").isin(*system) & F.col("table_catalog").isNotNull()
        & F.col("table_type").ilike("%table%") & (F.col("owner_role_type") != "APPLICATION"))


def _pct(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(part / total * 100, 1)).otherwise(F.lit(0.0))


def documentation_kpi(account_tables: DataFrame) -> DataFrame:
    """total, documented (non-NULL comment, the KPI rule), documented_nonblank (the
    listing rule), description_percentage (rounded to 0.1; 0 when there are no tables)."""
    t = kpi_tables(account_tables)
    return t.agg(F.count(F.lit(1)).alias("tables"),
                 F.count("comment").alias("tables_with_descriptions"),
                 F.count_if(~is_blank(F.col("comment"))).alias("tables_with_nonblank_descriptions"),
                 ).withColumn("description_percentage",
                              _pct(F.col("tables_with_descriptions"), F.col("tables")))


def monitor_count_parity(log: DataFrame) -> Column:
    """COUNT(DISTINCT database || schema || metric): no separator, no table; a NULL part
    drops the row (kept for parity)."""
    return F.count_distinct(F.concat("table_database", "table_schema", "metric_name"))


def monitors_kpi(log: DataFrame) -> DataFrame:
    return log.agg(monitor_count_parity(log).alias("dmf_count"))


def monitors_exact(results: DataFrame) -> DataFrame:
    """Distinct monitors (database, schema, table, column, metric), NULL parts kept."""
    keys = ["database_name", "schema_name", "table_name", "column_name", "monitor_name"]
    return results.select(*keys).distinct().agg(F.count(F.lit(1)).alias("monitors"))


def schemas_exact(objects: DataFrame) -> DataFrame:
    return schemas(objects, sort=False).agg(F.count(F.lit(1)).alias("schemas"))


def schemas_estimate(objects: DataFrame, sample: int = SCHEMA_SAMPLE_DATABASES) -> DataFrame:
    """Schemas of the first ``sample`` databases, scaled by databases/sampled, truncated."""
    dbs = databases(objects, sort=False)
    first = dbs.orderBy("database_name").limit(sample)
    in_sample = schemas(objects, sort=False).join(first, "database_name", "left_semi")
    row = combine({
        "n_db": dbs.agg(F.count(F.lit(1)).alias("value")),
        "n_sample": first.agg(F.count(F.lit(1)).alias("value")),
        "s": in_sample.agg(F.count(F.lit(1)).alias("value")),
    })
    est = F.when(F.col("n_sample") > 0,
                 F.floor(F.col("s") * (F.col("n_db") / F.col("n_sample")))).otherwise(F.col("s"))
    return row.select(est.cast("long").alias("schemas_estimate"))


def contacts_count(refs: DataFrame) -> DataFrame:
    """Distinct contacts (database, schema, name)."""
    return (refs.select("contact_database", "contact_schema", "contact_name").distinct()
            .agg(F.count(F.lit(1)).alias("contacts")))


def coverage(account_tables: DataFrame, monitored_keys: DataFrame, contact_keys: DataFrame) -> DataFrame:
    """Exact tables with monitors / with contacts: semi-joins of the KPI tables.

    ``*_keys`` carry (table_catalog, table_schema, table_name)."""
    t = kpi_tables(account_tables).select("table_catalog", "table_schema", "table_name")
    keys = ["table_catalog", "table_schema", "table_name"]
    monitored_keys, contact_keys = monitored_keys.distinct(), contact_keys.distinct()
    return combine({
        "tables_with_monitors": t.join(monitored_keys, keys, "left_semi").agg(F.count(F.lit(1)).alias("value")),
        "tables_with_contacts": t.join(contact_keys, keys, "left_semi").agg(F.count(F.lit(1)).alias("value")),
    }).select(*[F.col(c).cast("long").alias(c) for c in ("tables_with_monitors", "tables_with_contacts")])


def inventory_counts(objects: DataFrame) -> DataFrame:
    """One row (databases, schemas) from one scan: the distinct pairs, then per database."""
    db, schema = F.col("table_catalog"), F.col("table_schema")
    pairs = objects.select(db, schema).distinct()
    per_db = pairs.groupBy("table_catalog").agg(F.count_if(~schema.isin(*SYSTEM_SCHEMAS)).alias("n"))
    return per_db.agg(F.count_if(~db.isin(*SYSTEM_DATABASES)).alias("databases"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("schemas"))


def overview(account_tables: DataFrame, objects: DataFrame, log: DataFrame, refs: DataFrame) -> DataFrame:
    """The dashboard record: databases, schemas, tables, documented tables and
    percentage, metric count and contact count, with the parity guesses min(count, tables).
    Each source is read once."""
    row = combine_rows([
        inventory_counts(objects),
        documentation_kpi(account_tables).drop("tables_with_nonblank_descriptions"),
        monitors_kpi(log),
        contacts_count(refs).withColumnRenamed("contacts", "contacts_count")])
    longs = ["databases", "schemas", "tables", "tables_with_descriptions", "dmf_count", "contacts_count"]
    return row.select(
        *[F.col(c).cast("long").alias(c) for c in longs],
        "description_percentage",
        F.least(F.col("dmf_count"), F.col("tables")).cast("long").alias("tables_with_dmfs"),
        F.least(F.col("contacts_count"), F.col("tables")).cast("long").alias("tables_with_contacts"))


__all__ = ["SYSTEM_DATABASES", "combine", "coverage", "documentation_kpi", "monitors_exact",
           "monitors_kpi", "overview", "schemas_estimate", "schemas_exact", "contacts_count"]

"""Contacts: qualified names, live references, per-purpose pivot and change pairing
(S5, S6, S12, F10, J1, J5).

The reference looks contacts up one table at a time; here one pivot aggregate over
all references and one join against the object listing replace the N+1 lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The purposes shown as columns and the placeholder for a missing contact.
PURPOSES = ("STEWARD", "SUPPORT", "ACCESS_APPROVAL")
NOT_ASSIGNED = "Not assigned"
OBJECT_KEYS = ["object_database", "object_schema", "object_name"]


def contact_path(name="contact_name", database="contact_database", schema="contact_schema") -> Column:
    """``db.schema."name"``"""
    return F.concat(F.col(database), F.lit("."), F.col(schema), F.lit('."'), F.col(name), F.lit('"'))


def _complete(refs: DataFrame) -> DataFrame:
    ok = [F.col(c).isNotNull() & (F.col(c) != "")
          for c in ("contact_name", "contact_database", "contact_schema")]
    return refs.filter(ok[0] & ok[1] & ok[2])


def live(refs: DataFrame) -> DataFrame:
    """References whose object still exists."""
    return refs.filter(F.col("object_deleted").isNull())


def qualified_contacts(refs: DataFrame) -> DataFrame:
    """Selectable contact paths (distinct, incomplete rows dropped) plus the 'None' option."""
    paths = _complete(refs).select(contact_path().alias("contact")).distinct()
    none = refs.sparkSession.range(1).select(F.lit("None").alias("contact"))
    return none.unionByName(paths)


def current_contacts(refs: DataFrame) -> DataFrame:
    """One contact per (object, purpose): the greatest path when several are assigned."""
    return (_complete(live(refs)).groupBy(*OBJECT_KEYS, "contact_purpose")
            .agg(F.max(contact_path()).alias("contact")))


def contacts_pivot(objects: DataFrame, refs: DataFrame,
                   keys=("database_name", "schema_name", "object_name")) -> DataFrame:
    """Objects with one column per purpose (STEWARD, SUPPORT, ACCESS_APPROVAL).

    References are pre-aggregated to one row per object (pivot with fixed values: no
    extra job to discover them, partial aggregation on the map side), then joined 1:1.
    """
    piv = (_complete(live(refs)).groupBy(*OBJECT_KEYS)
           .pivot("contact_purpose", list(PURPOSES)).agg(F.max(contact_path())))
    piv = piv.select(*[F.col(o).alias(k) for o, k in zip(OBJECT_KEYS, keys)],
                     *[F.col(p).alias(p.lower()) for p in PURPOSES])
    j = objects.join(piv, list(keys), "left")
    for p in PURPOSES:
        j = j.withColumn(p.lower(), F.coalesce(F.col(p.lower()), F.lit(NOT_ASSIGNED)))
    return j


def contact_change_requests(refs: DataFrame, requests: DataFrame) -> DataFrame:
    """Pair requested assignments (database_name, schema_name, table_name, purpose,
    new_contact) with the current contact of the same object and purpose."""
    cur = current_contacts(refs).select(
        F.col("object_database").alias("database_name"), F.col("object_schema").alias("schema_name"),
        F.col("object_name").alias("table_name"), F.col("contact_purpose").alias("purpose"),
        F.col("contact").alias("old_contact"))
    keys = ["database_name", "schema_name", "table_name", "purpose"]
    return requests.join(cur, keys, "left").select(*keys, "old_contact", "new_contact")


def preview(refs: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` live references in a total order (top-k, no full sort)."""
    return live(refs).orderBy(*OBJECT_KEYS, "contact_purpose", "contact_name").limit(n)

"""Audit history: change rows for descriptions, metric configuration and contacts
(K1-K3), the history listings (S9) and their counters (A7, A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import comment_statement, split_last_dot
from tessera.functions.text import metric_action_sentence, metric_object_type
from tessera.operators.scalars import distinct_counts
from tessera.sinks.tables import with_hash_id

HISTORY_COLUMNS = ["database_name", "schema_name", "object_type", "object_name", "column_name",
                   "before_description", "after_description", "sql_executed", "updated_by",
                   "updated_at"]


def _clock(updated_at) -> Column:
    if updated_at is None:
        return F.current_timestamp()
    return F.lit(str(updated_at)).cast("timestamp")


def _user(updated_by) -> Column:
    return F.expr("current_user()") if updated_by is None else F.lit(updated_by)


def _text_or_null(c: Column) -> Column:
    """Falsy text ('' or NULL) -> NULL."""
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(c)


def description_change_rows(changes: DataFrame, updated_by=None, updated_at=None) -> DataFrame:
    """Changes (database_name, schema_name, object_name, object_type, before, after) -> history.

    For COLUMN changes ``object_name`` is ``table.column``: split at the LAST dot.
    """
    name = F.col("object_name")
    head, tail = split_last_dot(name)
    is_col = (F.col("object_type") == "COLUMN") & (F.instr(name, ".") > 0)
    table = F.when(is_col, head).otherwise(name)
    column = F.when(is_col, tail)
    return changes.select(
        "database_name", "schema_name", "object_type",
        table.alias("object_name"), column.alias("column_name"),
        _text_or_null(F.col("before_description")).alias("before_description"),
        _text_or_null(F.col("after_description")).alias("after_description"),
    ).withColumn("sql_executed", comment_statement(
        "object_type", "database_name", "schema_name", "object_name", "column_name",
        "after_description")
    ).withColumn("updated_by", _user(updated_by)).withColumn("updated_at", _clock(updated_at))


def metric_change_rows(checks: DataFrame, action: str = "ADDED", updated_by="tessera",
                       updated_at=None) -> DataFrame:
    """Metric configuration (database_name, schema_name, table_name, metric_name,
    column_name) -> history rows typed DMF_<metric>[_COLUMN] with an action sentence."""
    act = F.lit(action)
    return checks.select(
        "database_name", "schema_name",
        metric_object_type("metric_name", "column_name").alias("object_type"),
        F.col("table_name").alias("object_name"),
        F.when(F.col("column_name") != "", F.col("column_name")).alias("column_name"),
        F.lit(None).cast("string").alias("before_description"),
        metric_action_sentence(act, "metric_name", "column_name").alias("after_description"),
        F.lit(None).cast("string").alias("sql_executed"),
        _user(updated_by).alias("updated_by"),
        _clock(updated_at).alias("updated_at"),
    )


def contact_change_rows(changes: DataFrame, updated_by="tessera", updated_at=None) -> DataFrame:
    """(database_name, schema_name, table_name, purpose, old_contact, new_contact) ->
    history rows typed CONTACT_<purpose>; 'None'/'' become NULL; empty choices skipped."""
    def val(c):
        return F.when(c.isNull() | c.isin("None", ""), F.lit(None).cast("string")).otherwise(c)
    new = val(F.col("new_contact"))
    old = val(F.col("old_contact"))
    return changes.filter(F.col("new_contact").isNull() | (F.col("new_contact") != "")).select(
        "database_name", "schema_name",
        F.concat(F.lit("CONTACT_"), F.col("purpose")).alias("object_type"),
        F.col("table_name").alias("object_name"),
        F.lit(None).cast("string").alias("column_name"),
        old.alias("before_description"), new.alias("after_description"),
        F.lit(None).cast("string").alias("sql_executed"),
        _user(updated_by).alias("updated_by"),
        _clock(updated_at).alias("updated_at"),
    )


ID_PARTS = ("database_name", "schema_name", "object_type", "object_name", "column_name", "before_description",
            "after_description", "updated_by", "updated_at")


def with_history_id(rows: DataFrame) -> DataFrame:
    """Change rows with their ``history_id``; a change logged again by a retried job keeps its
    id."""
    return with_hash_id(rows, "history_id", ID_PARTS)


def description_history(history: DataFrame) -> DataFrame:
    """Description changes only (no DMF_ / CONTACT_ rows; ``_`` is a LIKE wildcard)."""
    t = F.col("object_type")
    return history.filter(~t.like("DMF_%") & ~t.like("CONTACT_%")).select(
        "history_id", "database_name", "schema_name", "object_type", "object_name", "column_name",
        "before_description", "after_description", "updated_by", "updated_at")


def metric_history(history: DataFrame) -> DataFrame:
    return history.filter(F.col("object_type").like("DMF_%")).select(
        "history_id", "database_name", "schema_name", "object_type", "object_name", "column_name",
        F.col("after_description").alias("action_description"), "updated_by", "updated_at")


def newest_changes(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("updated_at").desc(), F.col("history_id").desc()).limit(n)


def history_summary(desc_history: DataFrame) -> DataFrame:
    """Counters over the whole filtered log (not over a listing cap)."""
    return distinct_counts(desc_history, {"unique_objects": "object_name",
                                          "unique_users": "updated_by"}, total="total_changes")


def metric_history_summary(metric_hist: DataFrame) -> DataFrame:
    return distinct_counts(metric_hist, {"tables_configured": "object_name",
                                         "unique_metrics": "object_type"}, total="dmf_changes")

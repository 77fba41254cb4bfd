"""Check configuration over the column catalog.

All per-row projections or per-table aggregates (bounded by a table's width), so the
work scales with the catalog and never gathers more than one table in a group.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import metric_statement
from tessera.functions.registry import CORE_METRICS, get_metric

# Words in a column name that make it a freshness candidate.
FRESHNESS_NAME_WORDS = ("DATE", "TIME", "TIMESTAMP", "CREATED", "UPDATED")
TABLE_KEYS = ["table_catalog", "table_schema", "table_name"]


def type_matches(metric_name: str, data_type: Column) -> Column:
    """The reference's compatibility rule: 'ALL', else any listed type name is a
    substring of the upper-cased type (so TIME matches every TIMESTAMP*)."""
    m = get_metric(metric_name)
    if "ALL" in m.data_types:
        return F.lit(True)
    up = F.upper(data_type)
    return reduce(or_, [up.contains(t) for t in m.data_types])


def compatible_metrics(columns: DataFrame, metric_names=CORE_METRICS) -> DataFrame:
    """One row per (column, compatible column-level metric)."""
    names = [n for n in metric_names if get_metric(n).level == "column"]
    arr = F.array_compact(F.array(*[F.when(type_matches(n, F.col("data_type")), F.lit(n))
                                    for n in names]))
    return columns.select(*TABLE_KEYS, "column_name", "data_type",
                          F.explode(arr).alias("metric_name"))


def columns_by_type(columns: DataFrame) -> DataFrame:
    """Per table and type: the sorted column names joined by ', ' and their count."""
    return columns.groupBy(*TABLE_KEYS, "data_type").agg(
        F.array_join(F.sort_array(F.collect_list("column_name")), ", ").alias("columns"),
        F.count(F.lit(1)).alias("n_columns"))


def name_candidate(name: Column) -> Column:
    up = F.upper(name)
    return reduce(or_, [up.contains(w) for w in FRESHNESS_NAME_WORDS])


def freshness_candidates(columns: DataFrame) -> DataFrame:
    """Columns picked by name (the reference's heuristic) and/or by temporal type."""
    by_name = name_candidate(F.col("column_name"))
    by_type = type_matches("FRESHNESS", F.col("data_type"))
    return (columns.select(*TABLE_KEYS, "column_name", "data_type",
                           by_name.alias("by_name"), by_type.alias("by_type"))
            .filter(F.col("by_name") | F.col("by_type")))


def expand_checks(columns: DataFrame, column_metrics=("NULL_COUNT", "DUPLICATE_COUNT", "UNIQUE_COUNT"),
                  row_count: bool = True, freshness: bool = True) -> DataFrame:
    """Configuration -> one row per (table, metric, column) with its statement text.

    ROW_COUNT once per table; FRESHNESS once per table on a column of a temporal type, one
    with a time word in its name first, then by ordinal -- added once even though it is also column-compatible; the column metrics
    on every compatible column.
    """
    parts = []
    if row_count or freshness:
        # one aggregate per table gives both the table rows and its freshness column
        cand = type_matches("FRESHNESS", F.col("data_type"))
        by_name = name_candidate(F.col("column_name"))
        per_table = columns.groupBy(*TABLE_KEYS).agg(
            F.min(F.when(cand, F.struct((~by_name).alias("other_name"), "ordinal_position", "column_name")))
            .alias("_first"))
        items = []
        if row_count:
            items.append(F.struct(F.lit("ROW_COUNT").alias("metric_name"),
                                  F.lit(None).cast("string").alias("column_name")))
        if freshness:
            items.append(F.struct(F.lit("FRESHNESS").alias("metric_name"),
                                  F.col("_first.column_name").alias("column_name")))
        rows = per_table.select(*TABLE_KEYS, F.inline(F.array(*items)))
        parts.append(rows.filter((F.col("metric_name") != "FRESHNESS") | F.col("column_name").isNotNull()))
    comp = compatible_metrics(columns, column_metrics)
    parts.append(comp.select(*TABLE_KEYS, "metric_name", "column_name"))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumn("statement", metric_statement(
        "table_catalog", "table_schema", "table_name", "metric_name", "column_name"))


def check_counts(checks: DataFrame) -> DataFrame:
    """Per configured table: table-level checks, columns configured, column-level checks."""
    col = F.col("column_name")
    return checks.groupBy(*TABLE_KEYS).agg(
        F.count_if(col.isNull()).alias("table_level_checks"),
        F.count_distinct(col).alias("columns_configured"),
        F.count_if(col.isNotNull()).alias("column_level_checks"))

"""Monitoring over the measurement log: shaping, thresholds, filters, roll-ups (S8, F6,
F7, F13, F15, M16, A1-A6, T1-T3).

Everything here is a grouped aggregate or a projection over the (unbounded, append-only)
log: partial aggregation on the map side, one shuffle on the group keys, no driver work.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = {"24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}
MONITOR_KEYS = ["database_name", "schema_name", "table_name", "column_name", "monitor_name"]


def quality_results(log: DataFrame) -> DataFrame:
    """Measurement log -> results shape (rename, column from the argument arrays).

    STATUS here is the log's own: MEASURED when a value exists, else UNKNOWN; thresholds
    are NULL (see :func:`threshold_status` for PASS/FAIL).
    """
    types, names = F.col("argument_types"), F.col("argument_names")
    column = F.when(types.isNotNull() & (F.size(types) > 0) & (F.get(types, 0) == "COLUMN")
                    & names.isNotNull() & (F.size(names) > 0), F.get(names, 0))
    return log.select(
        "result_id",
        F.col("metric_name").alias("monitor_name"),
        F.col("table_database").alias("database_name"),
        F.col("table_schema").alias("schema_name"),
        "table_name",
        column.cast("string").alias("column_name"),
        F.col("value").alias("metric_value"),
        F.lit("numeric").alias("metric_unit"),
        F.lit(None).cast("double").alias("threshold_min"),
        F.lit(None).cast("double").alias("threshold_max"),
        F.when(F.col("value").isNotNull(), "MEASURED").otherwise("UNKNOWN").alias("status"),
        "measurement_time",
        F.col("measurement_time").alias("record_inserted_at"),
    )


def status_expr(value: Column, lo: Column, hi: Column) -> Column:
    """NULL value -> UNKNOWN; no bounds -> MEASURED; inside inclusive bounds -> PASS;
    else FAIL. A NULL bound leaves that side open."""
    inside = (lo.isNull() | (value >= lo)) & (hi.isNull() | (value <= hi))
    return (F.when(value.isNull(), "UNKNOWN")
            .when(lo.isNull() & hi.isNull(), "MEASURED")
            .when(inside, "PASS")
            .otherwise("FAIL"))


def threshold_status(results: DataFrame, thresholds: DataFrame,
                     keys=("monitor_name",)) -> DataFrame:
    """Attach thresholds (left join on ``keys``) and evaluate STATUS.

    ``thresholds`` is a policy table (one row per key); the join is planned by size --
    broadcast when the planner's statistics show it small, shuffle otherwise.
    """
    keys = list(keys)
    th = thresholds
    if "metric_name" in th.columns and "monitor_name" in keys and "monitor_name" not in th.columns:
        th = th.withColumnRenamed("metric_name", "monitor_name")
    th = th.select(*keys, F.col("threshold_min").alias("_lo"), F.col("threshold_max").alias("_hi"))
    # one policy per key: of several, the tightest bounds hold
    th = th.groupBy(*keys).agg(F.max("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
    base = results.drop("threshold_min", "threshold_max", "status")
    j = base.join(th, keys, "left")
    return (j.withColumn("threshold_min", F.col("_lo"))
             .withColumn("threshold_max", F.col("_hi"))
             .withColumn("status", status_expr(F.col("metric_value"), F.col("_lo"), F.col("_hi")))
             .drop("_lo", "_hi"))


def scope_filter(df: DataFrame, databases=(), schemas=(), db_col="database_name",
                 schema_col="schema_name") -> DataFrame:
    """database IN (...) AND ((db, schema) OR (db, schema) ...); ``schemas`` as 'db.schema'.

    The pairs are one set test per database, whatever their number."""
    conds = []
    if databases:
        conds.append(F.col(db_col).isin(list(databases)))
    by_database: dict[str, list[str]] = {}
    for d, s in (x.split(".", 1) for x in schemas):
        by_database.setdefault(d, []).append(s)
    if by_database:
        conds.append(reduce(or_, [(F.col(db_col) == d) & F.col(schema_col).isin(s) for d, s in by_database.items()]))
    return df.filter(reduce(and_, conds)) if conds else df


def time_range(df: DataFrame, range_key: str = "7d", as_of=None,
               ts_col: str = "measurement_time") -> DataFrame:
    """Relative window ending at ``as_of`` (default now): '24h', '7d' (default), '30d', 'all'."""
    if range_key == "all":
        return df
    clock = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    ts = F.col(ts_col)
    start = clock - F.expr(RANGES[range_key])
    if dict(df.dtypes)[ts_col] == "timestamp_ntz":
        start = start.cast("timestamp_ntz")
    if "measurement_date" in df.columns:
        # results written partitioned by date: the redundant date bound prunes partitions
        df = df.filter(F.col("measurement_date") >= F.to_date(start))
    return df.filter(ts >= start)


def newest(df: DataFrame, n: int, ts_col: str = "measurement_time", id_col: str = "result_id") -> DataFrame:
    """Top-n listing by time desc (id desc breaks ties): TakeOrderedAndProject, no full sort."""
    return df.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(n)


def monitor_summary(results: DataFrame) -> DataFrame:
    """One row per monitor (db, schema, table, column, metric); NULL column kept.

    LAST_STATUS is the status of the newest measurement (time, then id).
    """
    return results.groupBy(*MONITOR_KEYS).agg(
        F.max("measurement_time").alias("last_check"),
        F.max_by("status", F.struct("measurement_time", "result_id")).alias("last_status"),
        F.max("record_inserted_at").alias("configured_at"),
        F.min("measurement_time").alias("first_seen"),
    ).withColumnRenamed("monitor_name", "monitor_type")


def table_summary(monitors: DataFrame) -> DataFrame:
    """Per table: sorted distinct monitor types, monitored-column count, last check,
    overall status (MIXED when the monitors disagree)."""
    return monitors.groupBy("database_name", "schema_name", "table_name").agg(
        F.array_join(F.sort_array(F.collect_set("monitor_type")), ", ").alias("monitor_types"),
        F.count("column_name").alias("columns_monitored"),
        F.max("last_check").alias("last_check"),
        F.when(F.count_distinct("last_status") > 1, F.lit("MIXED"))
         .otherwise(F.min("last_status")).alias("overall_status"),
    )


def monitor_kpis(results: DataFrame) -> DataFrame:
    """Active monitors, tables monitored (distinct table names), checks."""
    per_monitor = results.groupBy(*MONITOR_KEYS).agg(F.count(F.lit(1)).alias("n"))
    return per_monitor.agg(
        F.count(F.lit(1)).alias("active_monitors"),
        F.count_distinct("table_name").alias("tables_monitored"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("quality_checks"))


def pass_rate(results: DataFrame) -> DataFrame:
    """Percent of checks with STATUS = 'PASS' (NULL status counts as not passing)."""
    return results.agg(
        F.round(F.avg(F.when(F.col("status") == "PASS", 1.0).otherwise(0.0)) * 100, 1)
        .alias("pass_rate"))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Counts per non-NULL value, most frequent first."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), F.col(col)))


def recent_monitors(monitors: DataFrame, n: int = 5) -> DataFrame:
    return monitors.orderBy(F.col("last_check").desc(), *[F.col(k).asc_nulls_first() for k in
                                                          ["database_name", "schema_name", "table_name",
                                                           "column_name", "monitor_type"]]).limit(n)


def recent_failures(results: DataFrame, n: int = 3) -> DataFrame:
    return newest(results.filter(F.col("status") == "FAIL"), n)

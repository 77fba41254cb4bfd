"""Registered scheduled/streaming measurement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.ledger import FileLedger
from tessera.operators.metrics import Check
from tessera.plans.base import AS_OF, ROUND_DIGITS, register
from tessera.plans.fixture_sql import with_ctes
from tessera.session import file_system, scratch_path, unique_name
from tessera.sinks.tables import append_and_read
from tessera.sources.fixtures import measurement_log
from tessera.sources.tables import read_table
from tessera.streaming import windows as W
from tessera.streaming.changes import on_change

DELAY = "1 hour"
_METRICS_SQL = ("count(*) AS row_count, count(*) FILTER (WHERE {v} IS NULL) AS null_count, "
                "round(avg({v}), 6) AS value_avg, min({v}) AS value_min, max({v}) AS value_max")


def _rounded(df):
    return df.withColumn("value_avg", F.round("value_avg", ROUND_DIGITS))


@register("metrics_by_window", with_ctes(f"""
SELECT time_bucket(INTERVAL 30 MINUTE, measurement_time) AS window_start,
  time_bucket(INTERVAL 30 MINUTE, measurement_time) + INTERVAL 30 MINUTE AS window_end,
  {_METRICS_SQL.format(v='value')}
FROM qr GROUP BY 1, 2""", "qr"))
def metrics_by_window(spark, sf_dir):
    """'Every 30 minutes': metrics of the measured values per 30-minute window."""
    return _rounded(W.window_metrics(measurement_log(spark, sf_dir), "measurement_time", "value",
                                     "30 minutes"))


@register("metrics_by_day", with_ctes(f"""
SELECT time_bucket(INTERVAL 1 DAY, measurement_time, INTERVAL '6 hours 30 minutes') AS window_start,
  time_bucket(INTERVAL 1 DAY, measurement_time, INTERVAL '6 hours 30 minutes') + INTERVAL 1 DAY AS window_end,
  {_METRICS_SQL.format(v='value')}
FROM qr GROUP BY 1, 2""", "qr"))
def metrics_by_day(spark, sf_dir):
    """'Daily at 06:30 UTC': day windows starting at 06:30."""
    return _rounded(W.window_metrics(measurement_log(spark, sf_dir), "measurement_time", "value",
                                     "1 day", W.daily_offset(6, 30)))


_CLOSED = "window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@register("stream_window_metrics", f"""
SELECT * FROM (
  SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
    time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, {_METRICS_SQL.format(v='value')}
  FROM events GROUP BY 1, 2) w WHERE {_CLOSED}""")
def stream_window_metrics(spark, sf_dir):
    """Events streamed from their files; day windows emitted when the watermark
    (max event time - 1 hour) passes their end."""
    s = W.file_stream(spark, sf_dir, "events")
    out = W.run_available(W.stream_window_metrics(s, "ts", "value", "1 day", DELAY), "window_metrics")
    return _rounded(out)


@register("stream_unique_duplicate", f"""
SELECT * FROM (
  SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
    time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
    count(DISTINCT user_id) AS unique_count, count(user_id) - count(DISTINCT user_id) AS duplicate_count
  FROM events GROUP BY 1, 2) w WHERE {_CLOSED}""")
def stream_unique_duplicate(spark, sf_dir):
    s = W.file_stream(spark, sf_dir, "events")
    return W.run_available(W.stream_distinct_counts(s, "ts", "user_id", "1 day", DELAY), "distinct_counts")


@register("stream_on_change", """
SELECT 'events' AS table_name, CAST(NULL AS VARCHAR) AS column_name, 'ROW_COUNT' AS metric_name,
  CAST(count(*) AS DOUBLE) AS value, 0 AS batch_id FROM events
UNION ALL SELECT 'events', 'value', 'NULL_COUNT', CAST(count(*) - count(value) AS DOUBLE), 0 FROM events
UNION ALL SELECT 'events', 'user_id', 'UNIQUE_COUNT', CAST(count(DISTINCT user_id) AS DOUBLE), 0 FROM events
UNION ALL SELECT 'events', 'user_id', 'DUPLICATE_COUNT',
  CAST(count(user_id) - count(DISTINCT user_id) AS DOUBLE), 0 FROM events""")
def stream_on_change(spark, sf_dir):
    """'When data changes': every new micro-batch of events is measured. The table arrives
    as one file, so (one file per trigger) it is one micro-batch, id 0."""
    s = W.file_stream(spark, sf_dir, "events", max_files=1)
    checks = [Check("ROW_COUNT"), Check("NULL_COUNT", "value"), Check("UNIQUE_COUNT", "user_id"),
              Check("DUPLICATE_COUNT", "user_id")]
    return on_change(s, checks, "events")


_ARRIVAL_CHECKS = [Check("ROW_COUNT"), Check("NULL_COUNT", "value"), Check("NULL_PERCENT", "value"),
                   Check("UNIQUE_COUNT", "user_id"), Check("DUPLICATE_COUNT", "user_id"),
                   Check("DUPLICATE_VALUES", "event_type"), Check("MAX", "value")]


def arrivals(spark, sf_dir, location: str):
    """Events arrive in two lots of several files (the second with the odd users); after
    each the schedule runs, and once more without news. Returns all results."""
    events = read_table(spark, sf_dir, "events")
    place = location + "/table"
    out = None
    for lot in (F.col("user_id") % 2 == 0, F.col("user_id") % 2 != 0, None):
        if lot is not None:
            events.where(lot).repartition(3, "event_id").write.mode("append").parquet(place)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(place)
        out = on_change(stream, _ARRIVAL_CHECKS, "events", location=location + "/run",
                          table=lambda: spark.read.parquet(place))
    return out


@register("stream_arrivals", """
SELECT 'events' AS table_name, CAST(NULL AS VARCHAR) AS column_name, 'ROW_COUNT' AS metric_name,
  CAST(count(*) AS DOUBLE) AS value FROM events
UNION ALL SELECT 'events', 'value', 'NULL_COUNT', CAST(count(*) - count(value) AS DOUBLE) FROM events
UNION ALL SELECT 'events', 'value', 'NULL_PERCENT', CAST(100 AS DOUBLE) * (count(*) - count(value)) / count(*) FROM events
UNION ALL SELECT 'events', 'user_id', 'UNIQUE_COUNT', CAST(count(DISTINCT user_id) AS DOUBLE) FROM events
UNION ALL SELECT 'events', 'user_id', 'DUPLICATE_COUNT', CAST(count(user_id) - count(DISTINCT user_id) AS DOUBLE) FROM events
UNION ALL SELECT 'events', 'event_type', 'DUPLICATE_VALUES',
  CAST((SELECT count(*) FROM (SELECT event_type FROM events WHERE event_type IS NOT NULL GROUP BY 1 HAVING count(*) > 1) g)
    AS DOUBLE)
UNION ALL SELECT 'events', 'value', 'MAX', CAST(max(value) AS DOUBLE) FROM events""")
def stream_arrivals(spark, sf_dir):
    """The last results of a schedule that resumed twice: about the whole table."""
    res = arrivals(spark, sf_dir, scratch_path(spark, "streams", unique_name("arrivals")))
    last = res.agg(F.max("batch_id").alias("batch_id"))
    return res.join(last, "batch_id", "left_semi").select("table_name", "column_name", "metric_name", "value")


@register("stream_windows_closed", f"""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
  time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, {_METRICS_SQL.format(v='value')}
FROM events GROUP BY 1, 2""")
def stream_windows_closed(spark, sf_dir):
    """Every day window of the stream: those emitted, and the open ones at its end."""
    s = W.file_stream(spark, sf_dir, "events")
    out = W.run_available(W.stream_window_metrics(s, "ts", "value", "1 day", DELAY), "windows_closed")
    return _rounded(W.with_open_windows(out, read_table(spark, sf_dir, "events"), "ts", "value", "1 day"))


@register("stream_unique_duplicate_closed", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
  time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
  count(DISTINCT user_id) AS unique_count, count(user_id) - count(DISTINCT user_id) AS duplicate_count
FROM events GROUP BY 1, 2""")
def stream_unique_duplicate_closed(spark, sf_dir):
    """Distinct counts of every day window of the stream: those emitted, and the open ones."""
    s = W.file_stream(spark, sf_dir, "events")
    out = W.run_available(W.stream_distinct_counts(s, "ts", "user_id", "1 day", DELAY), "distinct_closed")
    return W.with_open_windows(out, read_table(spark, sf_dir, "events"), "ts", "user_id", "1 day", distinct=True)


# ---------------------------------------------------------------- updates and deletes

_FEED_CHECKS = [Check("ROW_COUNT"), *(Check(m, "o_custkey") for m in (
    "NULL_COUNT", "UNIQUE_COUNT", "DUPLICATE_COUNT", "DUPLICATE_VALUES", "MIN", "MAX")),
    Check("AVG", "o_totalprice"), Check("NULL_PERCENT", "o_orderstatus"), Check("UNIQUE_COUNT", "o_orderstatus"),
    Check("FRESHNESS", "o_orderdate"), Check("ACCEPTED_VALUES", "o_orderpriority", (("values", ("1-URGENT", "2-HIGH")),))]


def change_feed(orders):
    """A feed of three lots: every order comes; every fifth changes its customer and loses its
    status; every seventh goes, in the state it then has."""
    columns = orders.columns
    changed = F.col("o_orderkey") % 5 == 0
    after = (orders.withColumn("o_custkey", F.when(changed, F.col("o_custkey") * 2 + 1).otherwise(F.col("o_custkey")))
             .withColumn("o_orderstatus", F.when(~changed, F.col("o_orderstatus"))))
    def lot(rows, kind):
        return rows.select(*columns, F.lit(kind).alias("change"))
    return [lot(orders, "insert"),
            lot(orders.where(changed), "update_preimage").unionByName(lot(after.where(changed), "update_postimage")),
            lot(after.where(F.col("o_orderkey") % 7 == 0), "delete")]


#: Rows of a file, about, in the tables that these queries write.
ROWS_A_FILE = 1 << 20


def feed_results(spark, sf_dir, location: str, compact_every: int = 2):
    """Results after every arrival of the feed: a lot comes in two arrivals, of one file or, if
    large, of several."""
    place, out = location + "/feed", None
    for lot in change_feed(read_table(spark, sf_dir, "orders")):
        files = max(1, -(-lot.count() // (2 * ROWS_A_FILE)))
        lot.repartition(2 * files, "o_orderkey").write.mode("append").parquet(place)
        stream = spark.readStream.schema(lot.schema).option("maxFilesPerTrigger", files).parquet(place)
        out = on_change(stream, _FEED_CHECKS, "orders", location=location + "/run", as_of=AS_OF, change_kind="change",
                        compact_every=compact_every)
    return out


@register("stream_change_feed", f"""
WITH t AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_custkey * 2 + 1 ELSE o_custkey END AS o_custkey, o_totalprice, o_orderdate,
    o_orderpriority, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus
  FROM orders WHERE o_orderkey % 7 <> 0)
SELECT 'orders' AS table_name, * FROM (
  SELECT CAST(NULL AS VARCHAR) AS column_name, 'ROW_COUNT' AS metric_name, CAST(count(*) AS DOUBLE) AS value FROM t
  UNION ALL SELECT 'o_custkey', 'NULL_COUNT', count(*) - count(o_custkey) FROM t
  UNION ALL SELECT 'o_custkey', 'UNIQUE_COUNT', count(DISTINCT o_custkey) FROM t
  UNION ALL SELECT 'o_custkey', 'DUPLICATE_COUNT', count(o_custkey) - count(DISTINCT o_custkey) FROM t
  UNION ALL SELECT 'o_custkey', 'DUPLICATE_VALUES', count(*) FROM (SELECT o_custkey FROM t WHERE o_custkey IS NOT NULL
    GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'o_custkey', 'MIN', min(o_custkey) FROM t
  UNION ALL SELECT 'o_custkey', 'MAX', max(o_custkey) FROM t
  UNION ALL SELECT 'o_totalprice', 'AVG', round(avg(o_totalprice), {ROUND_DIGITS}) FROM t
  UNION ALL SELECT 'o_orderstatus', 'NULL_PERCENT', 100.0::DOUBLE * (count(*) - count(o_orderstatus)) / count(*) FROM t
  UNION ALL SELECT 'o_orderstatus', 'UNIQUE_COUNT', count(DISTINCT o_orderstatus) FROM t
  UNION ALL SELECT 'o_orderdate', 'FRESHNESS', date_diff('second', max(o_orderdate)::TIMESTAMP, TIMESTAMP '{AS_OF}') FROM t
  UNION ALL SELECT 'o_orderpriority', 'ACCEPTED_VALUES', count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
    FROM t) r""")
def stream_change_feed(spark, sf_dir):
    """A table that gets inserts, updates and deletes, measured from its change feed: the
    results after the last arrival are those of the table as it then stands."""
    res = feed_results(spark, sf_dir, scratch_path(spark, "streams", unique_name("change_feed")))
    last = res.join(res.agg(F.max("batch_id").alias("batch_id")), "batch_id", "left_semi").drop("batch_id")
    return _rounded_avg(last)


def _rounded_avg(results):
    return results.withColumn("value", F.when(F.col("metric_name") == "AVG", F.round("value", ROUND_DIGITS))
                              .otherwise(F.col("value")))


# ---------------------------------------------------------------- by file

_LEDGER_CHECKS = [Check("ROW_COUNT"), Check("FRESHNESS", "ts"), Check("NULL_COUNT", "value"), Check("AVG", "value"),
                  Check("MAX", "event_id"), Check("UNIQUE_COUNT", "user_id"), Check("DUPLICATE_COUNT", "user_id"),
                  Check("DUPLICATE_VALUES", "event_type"), Check("UNIQUE_COUNT", "props")]


def event_lot(events, lot: int, files: int):
    """The events of one lot, dealt among so many files by their id: no task sorts them first."""
    return events.where(F.col("event_id") % 4 == lot).repartition(files, "event_id")


def ledger_runs(spark, sf_dir, location: str):
    """Events lie in files by event_id % 4. The table is measured with three of them, loses the
    first, gets the fourth, and is measured again: (ledger, table path, results)."""
    events = read_table(spark, sf_dir, "events")
    table = location + "/table"
    ledger = FileLedger(spark, location + "/ledger", _LEDGER_CHECKS, "events")
    files_a_lot = max(1, -(-events.count() // (4 * ROWS_A_FILE)))
    def add(lot):
        event_lot(events, lot, files_a_lot).write.mode("append").parquet(table)
    add(0)
    files, place = file_system(spark, table)
    first = [s.getPath() for s in files.listStatus(place) if s.getPath().getName().endswith(".parquet")]
    add(1)
    add(2)
    ledger.refresh(table, as_of=AS_OF).write.format("noop").mode("overwrite").save()
    for path in first:
        files.delete(path, False)
    add(3)
    return ledger, table, ledger.refresh(table, as_of=AS_OF)


@register("measure_file_ledger", f"""
WITH t AS (SELECT * FROM events WHERE event_id % 4 <> 0)
SELECT 'events' AS table_name, * FROM (
  SELECT CAST(NULL AS VARCHAR) AS column_name, 'ROW_COUNT' AS metric_name, CAST(count(*) AS DOUBLE) AS value FROM t
  UNION ALL SELECT 'ts', 'FRESHNESS', date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '{AS_OF}') FROM t
  UNION ALL SELECT 'value', 'NULL_COUNT', count(*) - count(value) FROM t
  UNION ALL SELECT 'value', 'AVG', round(avg(value), {ROUND_DIGITS}) FROM t
  UNION ALL SELECT 'event_id', 'MAX', max(event_id) FROM t
  UNION ALL SELECT 'user_id', 'UNIQUE_COUNT', count(DISTINCT user_id) FROM t
  UNION ALL SELECT 'user_id', 'DUPLICATE_COUNT', count(user_id) - count(DISTINCT user_id) FROM t
  UNION ALL SELECT 'event_type', 'DUPLICATE_VALUES', count(*) FROM (SELECT event_type FROM t WHERE event_type IS NOT NULL
    GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'props', 'UNIQUE_COUNT', count(DISTINCT props) FROM t) r""")
def measure_file_ledger(spark, sf_dir):
    """A table measured again after one file went and one came: only the new one is read."""
    *_, results = ledger_runs(spark, sf_dir, scratch_path(spark, "ledgers", unique_name("events")))
    return _rounded_avg(results)


@register("metrics_merge_partials", with_ctes("""
SELECT metric_name, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS nulls,
  round(sum(value), 6) AS value_sum, min(value) AS value_min, max(value) AS value_max
FROM qr GROUP BY metric_name""", "qr"))
def metrics_merge_partials(spark, sf_dir):
    """Daily partial states are stored, then merged over the whole range."""
    parts = W.partials(measurement_log(spark, sf_dir), "measurement_time", "value", ["metric_name"])
    stored = append_and_read(parts, "daily_partials")
    merged = W.merge_partials(stored, ["metric_name"])
    return merged.withColumn("value_sum", F.round("value_sum", ROUND_DIGITS))


@register("metrics_merge_sketch")
def metrics_merge_sketch(spark, sf_dir):
    """Distinct tables per metric estimated by merging daily HLL sketches (approximate)."""
    parts = W.partials(measurement_log(spark, sf_dir), "measurement_time", "value", ["metric_name"],
                       sketch_col="table_name")
    stored = append_and_read(parts, "daily_sketches")
    return W.merge_partials(stored, ["metric_name"]).select("metric_name", "n", "distinct_estimate")


#: How far a merged sketch may lie from the exact count: about five deviations at lg_k 12.
SKETCH_TOLERANCE = 0.08


@register("metrics_merge_sketch_tolerance", with_ctes("""
SELECT metric_name, count(*) AS n, count(DISTINCT table_name) AS exact, true AS within FROM qr GROUP BY metric_name""", "qr"))
def metrics_merge_sketch_tolerance(spark, sf_dir):
    """The merged daily sketches held against the exact distinct tables of each metric."""
    log = measurement_log(spark, sf_dir)
    stored = append_and_read(W.partials(log, "measurement_time", "value", ["metric_name"], sketch_col="table_name"), "daily_sketches")
    merged = W.merge_partials(stored, ["metric_name"]).select("metric_name", "n", "distinct_estimate")
    exact = log.groupBy("metric_name", "table_name").count().groupBy("metric_name").agg(F.count("table_name").alias("exact"))
    gap = F.abs(F.col("distinct_estimate") - F.col("exact"))
    return merged.join(exact, "metric_name").select("metric_name", "n", "exact", (gap <= SKETCH_TOLERANCE * F.col("exact")).alias("within"))

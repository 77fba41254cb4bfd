"""Scheduled and continuous measurement (W1-W6) with Structured Streaming.

* Schedules map to triggers: a periodic schedule is ``trigger(processingTime=...)``; a
  daily HH:MM schedule or "on change" runs ``availableNow`` from any outside scheduler
  or on file arrival. Runs that name the same ``location`` process only new input (the
  checkpoint there remembers).
* Metrics per event-time window: ``withWatermark`` + ``window`` aggregates in append mode;
  state is one row per open window (per window and value for distinct counts) and is
  dropped once the watermark passes the window's end.
* Partial states (count/sum/min/max and HLL sketches) are mergeable, so a range is
  answered from stored daily partials without rescanning the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import file_system, scratch_path, unique_name
from tessera.sources.tables import read_table, table_path


def _window(ts: str, duration: str, start_time: str | None = None) -> Column:
    if start_time:
        return F.window(ts, duration, duration, start_time)
    return F.window(ts, duration)


def scan_metrics(value: str) -> list[Column]:
    v = F.col(value)
    return [F.count(F.lit(1)).alias("row_count"),
            F.count_if(v.isNull()).alias("null_count"),
            F.avg(v).alias("value_avg"), F.min(v).alias("value_min"), F.max(v).alias("value_max")]


def window_metrics(df: DataFrame, ts: str, value: str, duration: str,
                   start_time: str | None = None) -> DataFrame:
    """Batch: metrics per tumbling window (``start_time`` offsets e.g. a daily HH:MM run)."""
    out = df.groupBy(_window(ts, duration, start_time).alias("w")).agg(*scan_metrics(value))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      *[c for c in out.columns if c != "w"])


def daily_offset(hour: int, minute: int) -> str:
    """``startTime`` for windows that begin every day at HH:MM UTC."""
    return f"{hour} hours {minute} minutes"


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the Parquet files of one table as they arrive (schema from the batch read).

    A table stored as a directory is streamed as is; a table stored as one file is
    streamed from its folder with a file-name filter (the file source needs a folder)."""
    path = table_path(sf_dir, name)
    r = spark.readStream.format("parquet").schema(read_table(spark, sf_dir, name).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if is_folder(spark, path):
        return r.load(path)
    return r.option("pathGlobFilter", f"{name}.parquet").load(sf_dir)


def is_folder(spark: SparkSession, path: str) -> bool:
    """One status call on whatever file system holds the path."""
    files, place = file_system(spark, path)
    return files.getFileStatus(place).isDirectory()


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast under the session time zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_window_metrics(stream: DataFrame, ts: str, value: str, duration: str,
                          delay: str) -> DataFrame:
    """Streaming: scan metrics per event-time window, emitted once the window closes."""
    s = with_event_time(stream, ts, delay)
    out = s.groupBy(F.window(ts, duration).alias("w")).agg(*scan_metrics(value))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "row_count", "null_count", "value_avg", "value_min", "value_max")


def stream_distinct_counts(stream: DataFrame, ts: str, key: str, duration: str,
                           delay: str, exact: bool = True) -> DataFrame:
    """Streaming UNIQUE / DUPLICATE per window without ``countDistinct`` (rejected on
    streams): (window, value) counts, then a second aggregation per window.

    Exact state is one row per (open window, value). ``exact=False`` keeps one HLL++
    state per open window instead (bounded size, ~5% error)."""
    s = with_event_time(stream, ts, delay)
    if not exact:
        k = F.col(key)
        out = s.groupBy(F.window(ts, duration).alias("w")).agg(
            F.approx_count_distinct(k).alias("unique_count"),
            (F.count(k) - F.approx_count_distinct(k)).alias("duplicate_count"))
        return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "unique_count", "duplicate_count")
    return window_distinct_counts(s, ts, key, duration)


def window_distinct_counts(df: DataFrame, ts: str, key: str, duration: str) -> DataFrame:
    """UNIQUE / DUPLICATE per tumbling window, of a table or a stream: rows by window and
    value, then by window."""
    per_value = df.groupBy(F.window(ts, duration).alias("w"), F.col(key).alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    per_window = per_value.groupBy("w").agg(
        F.count("v").alias("unique_count"),
        (F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)) - F.count("v"))
        .alias("duplicate_count"))
    return per_window.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                             "unique_count", "duplicate_count")


def _start_with_state_partitions(spark: SparkSession, writer, state_partitions: int | None):
    """Start a query with a deliberate number of state partitions: a stateful stream keeps
    the shuffle partition count of its first start for its whole life (it is stored in
    the checkpoint), so it is sized here -- by default to the cluster's parallelism."""
    n = state_partitions or spark.sparkContext.defaultParallelism
    key = "spark.sql.shuffle.partitions"
    prev = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, prev)


def run_available(df: DataFrame, name: str, output_mode: str = "append",
                  state_partitions: int | None = None, location: str | None = None) -> DataFrame:
    """Run a streaming frame over everything available into a Parquet table (exactly-once
    file sink + checkpoint), then return the table.

    ``location`` is a shared folder that holds table and checkpoint: the next call with it
    resumes, so a schedule processes only what is new. Without it the run stands alone, in
    a new folder under the shared root."""
    spark = df.sparkSession
    out = location or scratch_path(spark, "streams", unique_name(name))
    w = (df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", out + "/_checkpoint").option("path", out + "/data")
         .trigger(availableNow=True))
    q = _start_with_state_partitions(spark, w, state_partitions)
    q.awaitTermination()
    return spark.read.parquet(out + "/data")


def with_open_windows(closed: DataFrame, source: DataFrame, ts: str, value: str, duration: str,
                      distinct: bool = False) -> DataFrame:
    """Emitted windows plus those still open, measured from the table behind the stream:
    the closing step of a schedule, or a look at today. Only rows after the last emitted
    window are read. ``distinct`` says that the windows are those of
    :func:`stream_distinct_counts` over ``value``, and not of :func:`stream_window_metrics`."""
    last = closed.agg(F.max("window_end")).first()[0]
    stamped = source.withColumn(ts, F.col(ts).cast("timestamp"))
    rest = stamped if last is None else stamped.where(F.col(ts) >= F.lit(last))
    of_open = (window_distinct_counts if distinct else window_metrics)(rest, ts, value, duration)
    return closed.unionByName(of_open.select(*closed.columns))


def start_periodic(df: DataFrame, path: str, checkpoint: str, every: str = "30 minutes",
                   state_partitions: int | None = None):
    """A periodic schedule ('Every N minutes/hours'): a processing-time trigger."""
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", path)
         .trigger(processingTime=every))
    return _start_with_state_partitions(df.sparkSession, w, state_partitions)


# ---------------------------------------------------------------- mergeable partials

def partials(df: DataFrame, ts: str, value: str, keys=(), sketch_col: str | None = None,
             lg_k: int = 12) -> DataFrame:
    """Daily partial states per key: counts, sum, min, max (+ an HLL sketch)."""
    v = F.col(value)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"),
            F.sum(v).alias("value_sum"), F.min(v).alias("value_min"), F.max(v).alias("value_max")]
    if sketch_col:
        aggs.append(F.hll_sketch_agg(F.col(sketch_col), lg_k).alias("sketch"))
    return df.groupBy(F.to_date(ts).alias("day"), *keys).agg(*aggs)


def merge_partials(parts: DataFrame, keys=(), start=None, end=None) -> DataFrame:
    """Combine stored partials over [start, end] (dates; None = open) per key."""
    p = parts
    if start is not None:
        p = p.filter(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        p = p.filter(F.col("day") <= F.lit(end).cast("date"))
    aggs = [F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("value_sum").alias("value_sum"),
            F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max")]
    if "sketch" in p.columns:
        aggs.append(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))
    return p.groupBy(*keys).agg(*aggs)

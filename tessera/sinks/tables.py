"""Sinks: append-only log tables, CSV export, results writer (K1-K4, K7).

Writes go through Spark's file commit protocol, so a lost executor's task is retried
without duplicating output. Paths live under the shared checkpoint root unless a
caller passes a table location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path, unique_name


def append_table(df: DataFrame, path: str, partition_by=None) -> str:
    """Append ``df`` as Parquet at ``path`` (optionally partitioned, e.g. by date)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_run(df: DataFrame, path: str, partition_by) -> str:
    """Idempotent write of one run: dynamic partition overwrite, so a re-run of the same
    run (same partition values, e.g. measurement date + run id) replaces its partitions
    instead of appending a second copy; other runs' partitions are untouched."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by).parquet(path))
    return path


def log_run(df: DataFrame, path: str, run_id: str) -> str:
    """Add one run's rows to a log: a retry of the run replaces its own rows."""
    return write_run(df.withColumn("run_id", F.lit(run_id)), path, ["run_id"])


def append_and_read(df: DataFrame, kind: str, partition_by=None) -> DataFrame:
    """Append into a fresh log location under the shared root and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, kind, unique_name(kind))
    append_table(df, path, partition_by)
    out = spark.read.parquet(path)
    return out.select(*df.columns) if not partition_by else out


def with_hash_id(df: DataFrame, id_col: str, cols) -> DataFrame:
    """Key from the row's content (no global ordering, no autoincrement; the same change
    logged twice gets the same key): SHA-256 of its parts, each marked as NULL or with its
    length, so no two different rows spell alike."""
    def part(c: str):
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.lit("V"), F.char_length(text).cast("string"), F.lit(":"), text), F.lit("N"))
    return df.withColumn(id_col, F.sha2(F.concat(*[part(c) for c in cols]), 256))


# microsecond precision survives the round trip (the CSV default keeps milliseconds)
CSV_TIME_FORMATS = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
                    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


# quotes are doubled (RFC 4180), texts may hold newlines, '' and NULL stay apart
CSV_TEXT = {"escape": '"', "quoteAll": True, "nullValue": "\\N", "emptyValue": "",
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_name(prefix: str, now=None) -> str:
    """``<prefix>_YYYYmmdd_HHMMSS.csv`` (UTC), the export file naming."""
    import datetime as dt
    now = now or dt.datetime.now(dt.timezone.utc)
    return f"{prefix}_{now.strftime('%Y%m%d_%H%M%S')}.csv"


def export_csv(df: DataFrame, path: str) -> str:
    """CSV with a header row, one directory of part files (``coalesce`` is not used:
    the export stays parallel at any size)."""
    (df.write.mode("overwrite").option("header", True).options(**CSV_TIME_FORMATS, **CSV_TEXT).csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.option("header", True).option("multiLine", True)
            .options(**CSV_TIME_FORMATS, **CSV_TEXT).schema(schema).csv(path))

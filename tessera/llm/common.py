"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path, unique_name

#: A table may be broadcast while it has at most this many (narrow) rows.
SMALL_ROWS = 20_000

#: Row groups of written tables: a reader holds one of them at a time.
BLOCK_BYTES = 32 << 20

#: Text bytes that one step of an Arrow function works on at a time.
STEP_BYTES = 4 << 20


def materialize(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts the lineage,
    so a lost executor costs a re-read and no re-computation. Tables of rows of a megabyte or
    more name the rows of a row group: Parquet's writer looks at its size after 100 rows only."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", unique_name(name))
    write = df.write.option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES)
    (write.option("parquet.block.row.count.limit", group_rows) if group_rows else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside pass their rows to Python in batches of at most ``rows``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small, else as it is (shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key() -> Column:
    """A document, never null: the digest of its text (null counts as empty), then its id."""
    return F.concat(F.sha2(text_of("text"), 256), F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose :func:`row_key` is not in ``gone`` (``key``)."""
    key = "__row_key"
    return docs.withColumn(key, row_key()).join(gone.select(F.col("key").alias(key)).distinct(), key, "left_anti").drop(key)


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Null-safe equality on ``columns``: rows with a null key meet their own kind."""
    cond = None
    for c in columns:
        one = left[c].eqNullSafe(right[c])
        cond = one if cond is None else cond & one
    return cond


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text",
               limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text (one row at
    least), so that memory does not follow the number of rows in a batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the row offsets into it (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


#: Byte tables. White space is 0x09-0x0D and 0x20.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each white-space separated word, and the words of each row."""
    word = ~IS_SPACE[data]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    after = np.empty_like(word)
    after[:-1] = word[1:]
    firsts, lasts = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    before[firsts] = False
    after[lasts] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts

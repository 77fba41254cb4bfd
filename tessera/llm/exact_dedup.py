"""Exact deduplication with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, same, text_of

#: Candidates taken from the frequency summary: the bound of what is broadcast.
HEAVY_ITEMS = 256
#: Counters of the summary. A digest with more than 1/SUMMARY_ITEMS of all rows is in it.
SUMMARY_ITEMS = 1024


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Rows with equal text (null counts as empty) form a group; the one with the largest
    ``doc_id`` stays. Hot groups never meet in one task: a Misra-Gries summary (the
    built-in frequent-items sketch, one bounded partial per task) names at most
    ``HEAVY_ITEMS`` digests, exact counts verify them, and their rows get their result by a
    map-side join with that bounded list, before any shuffle. All other digests are grouped
    by a shuffle of digests; texts are never shuffled.

    Every row counts, also one that repeats another; of rows with the largest ``doc_id`` of
    a group one stays. A null ``doc_id`` loses to every other id; if a group has no other,
    ``keep_id`` is null and one of its rows is kept. Columns besides ``doc_id`` and ``text``
    are ignored. No rows in, no rows out.
    """
    # written, so that a row keeps its number
    base = materialize(docs.select("doc_id", F.sha2(text_of("text"), 256).alias("text_sha256"),
                                   F.monotonically_increasing_id().alias("row")), "exact_digests")
    summary = base.agg(F.expr(f"approx_top_k(text_sha256, {HEAVY_ITEMS}, {SUMMARY_ITEMS})").alias("top"))
    named = summary.select(F.explode("top").alias("top")).select(F.col("top.item").alias("text_sha256"))
    keep = [F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")]
    total = base.count()
    heavy = materialize(base.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(*keep)
                        .where(F.col("group_size") * SUMMARY_ITEMS > total), "exact_heavy")
    mapped = base.join(F.broadcast(heavy), "text_sha256")
    rest = base.join(F.broadcast(heavy), "text_sha256", "left_anti")
    shuffled = rest.join(rest.groupBy("text_sha256").agg(*keep), "text_sha256")
    return mapped.unionByName(shuffled).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256")


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    A repeated row (same ``doc_id`` and text) stays once.
    """
    found = exact_duplicates(docs).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256")
    digest = "__text_sha256"
    rows = docs.withColumn(digest, F.sha2(text_of("text"), 256))
    gone = found.withColumnRenamed("text_sha256", digest)
    left = rows.join(gone, same(rows, gone, "doc_id", digest), "left_anti")
    return left.dropDuplicates(["doc_id", digest]).drop(digest)

"""One-row results assembled from several scalar aggregates without joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import col_ref


def combine(values: dict[str, DataFrame]) -> DataFrame:
    """{name: one-row frame with column ``value``} -> one row, one column per name
    (a union of the scalars and one tiny pivot aggregate)."""
    names = list(values)
    long = reduce(lambda a, b: a.unionByName(b),
                  [df.select(F.lit(n).alias("kpi"), F.col("value").cast("double").alias("value"))
                   for n, df in values.items()])
    return long.groupBy().pivot("kpi", names).agg(F.first("value"))


def combine_rows(frames: list[DataFrame]) -> DataFrame:
    """One-row frames of numbers -> one row with all their columns as doubles: each source
    stays one aggregate, however many of its columns are wanted."""
    names = [c for df in frames for c in df.columns]
    long = reduce(lambda a, b: a.unionByName(b), [
        df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("kpi"), col_ref(c).cast("double").alias("value"))
                                     for c in df.columns]))) for df in frames])
    return long.groupBy().pivot("kpi", names).agg(F.first("value"))


def distinct_counts(df: DataFrame, columns: dict[str, str], total: str | None = None) -> DataFrame:
    """One row: ``total`` (row count) and, per output name, the distinct non-NULL count of a
    text column. One scan: every row becomes one (column, value) entry per column, and
    partial aggregation keeps one entry per value and map task."""
    entries = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), col_ref(c).cast("string").alias("v"))
                                 for i, c in enumerate(columns.values())]))
    groups = df.select(entries).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    out = [F.count_if((F.col("c") == i) & F.col("v").isNotNull()).alias(name) for i, name in enumerate(columns)]
    if total:
        out.insert(0, F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("n"))), F.lit(0)).alias(total))
    return groups.agg(*out)

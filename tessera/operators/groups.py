"""Value groups: the rows of a table by column and value, with signed counts.

Groups add up: those of two lots of rows give those of both, and groups with negative counts
take rows away again. So counts, distinct counts and extremes of a changing table follow
from stored groups, and old rows are never read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.canonical import canonical_text, is_nested
from tessera.operators.metrics import WHOLE, Check, _accepted_list, _stack, col_ref, sql_literal

GROUP_SCHEMA = "column_name string, v string, n long"

#: Metrics that follow from the groups of a column (ACCEPTED_VALUES: of a text, from a list).
MERGED = ("ROW_COUNT", "NULL_COUNT", "NULL_PERCENT", "UNIQUE_COUNT", "DUPLICATE_COUNT", "DUPLICATE_VALUES", "MIN", "MAX",
          "AVG", "FRESHNESS", "ACCEPTED_VALUES")

#: Group column of a configuration that only counts rows.
ROWS_ONLY = ""

#: Entries (a row has one per column) that a task groups at most, about: its memory does not
#: grow with the files, row groups or splits of the input.
ENTRIES_A_TASK = 1 << 19


def tasks_for(entries: int) -> int:
    """Tasks among which so many entries are dealt."""
    return max(1, -(-entries // ENTRIES_A_TASK))


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """The rows, dealt evenly among so many tasks.

    Spark deals straight into files among up to ``bypassMergeThreshold`` tasks, and beyond that
    holds what a task has read. So rows for more tasks are first dealt among as many as that,
    and by their number from there: no task holds a whole split, however many files it has."""
    straight = int(rows.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if tasks <= max(1, straight):
        return rows.repartition(tasks)
    first = rows.withColumn("__i", F.monotonically_increasing_id()).repartition(max(1, straight))
    # the hash between the two keeps them two: neighbours would be planned as one
    return first.withColumn("__i", F.xxhash64("__i")).repartition(tasks, "__i").drop("__i")


def from_groups(check: Check, dtype: T.DataType | None) -> bool:
    """Whether the groups give this check."""
    if check.metric == "ACCEPTED_VALUES":
        return _accepted_list(dtype, check) is not None
    return check.metric in MERGED and not check.params


def _key(dtype: T.DataType, column: str) -> Column:
    """A value as text that casts back, or as the digest of a long or nested one."""
    if is_nested(dtype):
        return F.sha2(F.expr(canonical_text(dtype, f"`{column.replace('`', '``')}`")), 256)
    c = col_ref(column)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0).cast(dtype)                              # -0.0 and 0.0 are one value
    text = F.base64(c) if isinstance(dtype, T.BinaryType) else c.cast("string")
    return F.when(F.octet_length(text) < 64, text).otherwise(F.sha2(text, 256))


def value_groups(df: DataFrame, columns: list[str], weight: Column | None = None, by=(), tasks: int = 1) -> DataFrame:
    """``*by, column_name, v, n``: the rows of ``df`` by value, ``weight`` each (default 1).

    With ``tasks`` above 1 the rows are first dealt evenly among so many tasks."""
    types = {f.name: f.dataType for f in df.schema.fields}
    held = {c: f"__c{i}" for i, c in enumerate(columns or [ROWS_ONLY])}
    entries = [F.struct(F.lit(c).alias("column_name"),
                        (F.lit(None).cast("string") if c == ROWS_ONLY else _key(types[c], at)).alias("v"))
               for c, at in held.items()]
    rows = df.select(*by, (F.lit(1) if weight is None else weight).cast("long").alias("__n"),
                     *(col_ref(c).alias(at) for c, at in held.items() if c != ROWS_ONLY))
    if tasks > 1:
        rows = _dealt(rows, tasks)
    weighed = rows.select(*by, F.col("__n").alias("n"), F.inline(F.array(*entries)))
    return weighed.groupBy(*by, "column_name", "v").agg(F.sum("n").alias("n"))


@contextmanager
def _shuffled_into(spark: SparkSession, tasks: int) -> Iterator[None]:
    """While this holds, shuffles have so many tasks, however well their bytes compress, and rows
    are dealt evenly in the order they are read: sorting them first would hold a whole split."""
    conf = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.execution.sortBeforeRepartition": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_groups(groups: DataFrame, path: str, tasks: int, mode: str = "errorifexists") -> None:
    """Write value groups as Parquet, added up in ``tasks`` tasks."""
    with _shuffled_into(groups.sparkSession, tasks):
        groups.write.mode(mode).parquet(path)


def add_up(groups: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per column and value; what came to nothing is gone.

    ``tasks`` suits stored groups, where few rows share a value: they are dealt by value among
    so many tasks, and not first gathered in those that read them."""
    if tasks:
        groups = groups.repartition(tasks, "column_name", "v")
    return groups.groupBy("column_name", "v").agg(F.sum("n").alias("n")).where("n != 0")


def _expressions(check: Check, dtype: T.DataType | None, first: str, as_of) -> tuple[str, str | None]:
    """SQL for the value of a check over added-up groups, and for its exact text."""
    on = f"column_name = {sql_literal(check.column or first)}"
    here = f"{on} AND v IS NOT NULL"
    rows, present = f"coalesce(sum(CASE WHEN {on} THEN n END), 0)", f"coalesce(sum(CASE WHEN {here} THEN n END), 0)"
    nulls = f"coalesce(sum(CASE WHEN {on} AND v IS NULL THEN n END), 0)"
    unique = f"count_if({here})"
    typed = f"CASE WHEN {here} THEN CAST(v AS {dtype.simpleString()}) END" if dtype is not None and not is_nested(dtype) else ""
    if check.metric in ("MIN", "MAX"):
        value = f"{check.metric.lower()}({typed})"
        return value, f"CAST({value} AS STRING)"
    if check.metric == "AVG":
        return f"sum(CASE WHEN {here} THEN CAST(v AS DOUBLE) * n END) / nullif({present}, 0)", None
    if check.metric == "FRESHNESS":
        clock = "current_timestamp()" if as_of is None else f"to_timestamp({sql_literal(str(as_of))})"
        value = f"unix_timestamp({clock}) - unix_timestamp(max({typed}))"
    elif check.metric == "ACCEPTED_VALUES":
        accepted = ", ".join(map(sql_literal, _accepted_list(dtype, check)))
        value = f"coalesce(sum(CASE WHEN {here} AND v NOT IN ({accepted}) THEN n END), 0)"
    elif check.metric == "NULL_PERCENT":
        return f"CAST(100.0 AS DOUBLE) * {nulls} / nullif({rows}, 0)", None
    else:
        value = {"ROW_COUNT": rows, "NULL_COUNT": nulls, "UNIQUE_COUNT": unique, "DUPLICATE_COUNT": f"{present} - {unique}",
                 "DUPLICATE_VALUES": f"count_if({here} AND n > 1)"}[check.metric]
    return value, value


def merged_metrics(groups: DataFrame, checks: list[Check], types: dict[str, T.DataType], table_name: str, as_of=None,
                   texts: bool = False, tasks: int | None = None) -> DataFrame:
    """Results of the table that the groups make up, one long row per check; ``tasks`` as in
    :func:`add_up`.

    A value of which more rows were taken away than came so far counts as absent; the rows
    that are still due keep it in balance."""
    first = next((c.column for c in checks if c.column), ROWS_ONLY)
    whole = add_up(groups, tasks).where("n > 0")
    aggs, items = [], []
    for i, c in enumerate(checks):
        value, text = _expressions(c, types.get(c.column), first, as_of)
        aggs.append(F.expr(f"{value} AS _m{i}"))
        if c.metric in ("MIN", "MAX"):
            aggs.append(F.expr(f"{text} AS _t{i}"))
        items.append((c.column, c.metric, f"_m{i}", f"_t{i}" if c.metric in ("MIN", "MAX") else
                      f"_m{i}" if c.metric in WHOLE else None))
    out = whole.agg(*aggs).selectExpr(_stack(table_name, items))
    return out if texts else out.drop("value_text")

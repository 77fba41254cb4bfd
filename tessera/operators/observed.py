"""Metrics of a table while it is written: the writing job itself measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.registry import get_metric
from tessera.operators.metrics import (
    Check, _failed_rows, _needs_domain_join, _scan_aggregates, _scan_items, _stack, col_ref, measure, validate_checks,
)


class Observed:
    """``frame`` is to be written; then :meth:`results` gives the metrics it met on the way."""

    def __init__(self, df: DataFrame, checks: list[Check], table_name: str, as_of=None):
        self.table_name = table_name
        self.part, self.failed = [], []
        for ch in checks:
            m = get_metric(ch.metric)
            params = {"as_of": as_of, **ch.param_dict()}
            if ch.column:
                params["column_sql"] = "`" + ch.column.replace("`", "``") + "`"
            try:
                one = (ch, m, m.build(col_ref(ch.column) if ch.column else None, params))
                df.agg(*_scan_aggregates([one]))                  # analysis only: an expression that does not resolve
                self.part.append(one)
            except Exception as e:
                self.failed.append((ch, str(e)))
        self.observation = Observation()
        self.aggregates = _scan_aggregates(self.part)
        self.schema = df.agg(*self.aggregates).schema if self.part else None
        self.frame = df.observe(self.observation, *self.aggregates) if self.part else df

    def results(self, reasons: bool = False, texts: bool = False) -> DataFrame:
        """Long rows of the finished write (waits for it)."""
        spark = self.frame.sparkSession
        out = _failed_rows(spark, [(self.table_name, ch, why) for ch, why in self.failed], reasons, texts)
        if not self.part:
            return out
        got = self.observation.get
        row = spark.createDataFrame([tuple(got[f.name] for f in self.schema.fields)], self.schema)
        met = row.selectExpr(_stack(self.table_name, _scan_items(self.part)))
        met = met if texts else met.drop("value_text")
        met = met.withColumn("error", F.lit(None).cast("string")) if reasons else met
        return met.unionByName(out) if self.failed else met


def write_measured(df: DataFrame, path: str, checks, table_name: str, *, as_of=None, reasons: bool = False,
                   texts: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and return the results of ``checks`` on it.

    Scan metrics are observed by the tasks that write (each finished task counts once, also
    when one is repeated), so the source runs once, in full, and is not read for them. Counts
    by value need a shuffle: they, and accepted values from a table, are measured on the
    written files, of which only their columns are read. ``mode="append"`` is refused, since
    the files would hold more than was observed."""
    if mode == "append":
        raise ValueError("an append writes a part of the table only; measure the table itself")
    ok, failed = validate_checks(df, checks)
    later = [c for c in ok if get_metric(c.metric).kind != "scan" or _needs_domain_join(c)]
    seen = Observed(df, [c for c in ok if c not in later], table_name, as_of)
    seen.failed += failed
    seen.frame.write.mode(mode).parquet(path)
    parts = [seen.results(reasons, texts)]
    if later:
        written = df.sparkSession.read.schema(df.schema).parquet(path)
        parts.append(measure(written, later, table_name, as_of=as_of, reasons=reasons, texts=texts))
    return reduce(lambda a, b: a.unionByName(b), parts)

"""Metric registry: the extension point for data-quality metrics.

A metric is either a *scan* metric -- one aggregate expression, evaluated together with
every other scan metric of the table in a single partial+final hash aggregate -- or a
*distinct* metric, which needs the rows grouped by value (UNIQUE_COUNT and the two
duplicate counts); those share one ``groupBy(column)`` per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[Column, dict], Column]


@dataclass(frozen=True)
class Metric:
    name: str
    level: str                      # "table" or "column"
    data_types: tuple[str, ...]     # catalog type-name substrings; ("ALL",) = any type
    kind: str                       # "scan" or "distinct"
    build: Builder | None = None    # scan metrics: (column, params) -> aggregate Column
    accepts: Callable[[T.DataType], bool] = field(default=lambda t: True)
    description: str = ""


_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _is_temporal(t: T.DataType) -> bool:
    return isinstance(t, _TEMPORAL)


def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _as_of(params: dict) -> Column:
    as_of = params.get("as_of")
    if as_of is None:
        return F.current_timestamp()
    return F.to_timestamp(F.lit(str(as_of)))


def _freshness(c: Column, p: dict) -> Column:
    # whole seconds between the newest value and the measurement clock (UTC)
    return (F.unix_timestamp(_as_of(p)) - F.unix_timestamp(F.max(c))).cast("double")


def _null_percent(c: Column, p: dict) -> Column:
    n = F.count(F.lit(1))
    return F.when(n > 0, F.lit(100.0) * F.count_if(c.isNull()) / n)


def _accepted(c: Column, p: dict) -> Column:
    # a NULL in the list accepts nothing: NULLs of the column are never counted anyway
    values = [v for v in p.get("values") or [] if v is not None]
    return F.count_if(c.isNotNull() & ~c.isin(values)).cast("double")


# The metric names and the temporal type names accepted by FRESHNESS must
# equal the reference's for configurations to carry over.
TEMPORAL_TYPE_NAMES = ("DATE", "TIME", "TIMESTAMP", "TIMESTAMP_LTZ", "TIMESTAMP_NTZ", "TIMESTAMP_TZ")
NUMERIC_TYPE_NAMES = ("NUMBER", "DECIMAL", "INT", "FLOAT", "DOUBLE", "REAL", "NUMERIC", "LONG", "SHORT", "BYTE")

_REGISTRY: dict[str, Metric] = {}


def register_metric(metric: Metric) -> Metric:
    """Add or replace a metric. Scan metrics need ``build``."""
    if metric.kind not in ("scan", "distinct"):
        raise ValueError(f"unknown metric kind {metric.kind!r}")
    if metric.kind == "scan" and metric.build is None:
        raise ValueError("scan metrics need a builder")
    _REGISTRY[metric.name] = metric
    return metric


def sql_metric(name: str, expression: str, level: str = "column",
               data_types: tuple[str, ...] = ("ALL",), description: str = "") -> Metric:
    """Register a custom aggregate written in Spark SQL; ``{col}`` names the column.

    Example: ``sql_metric("NEGATIVE_COUNT", "count_if({col} < 0)")``.
    """
    def build(c: Column, p: dict, _e=expression) -> Column:
        col_name = p.get("column_sql", "")
        return F.expr(_e.format(col=col_name)).cast("double")

    return register_metric(Metric(name, level, data_types, "scan", build, description=description))


def get_metric(name: str) -> Metric:
    try:
        return _REGISTRY[name.upper()]
    except KeyError:
        raise KeyError(f"unknown metric {name!r}") from None


def metrics() -> dict[str, Metric]:
    return dict(_REGISTRY)


for _m in (
    Metric("ROW_COUNT", "table", (), "scan",
           lambda c, p: F.count(F.lit(1)).cast("double"), description="rows in the table"),
    Metric("FRESHNESS", "column", TEMPORAL_TYPE_NAMES, "scan", _freshness,
           accepts=_is_temporal, description="seconds since the newest value"),
    Metric("NULL_COUNT", "column", ("ALL",), "scan",
           lambda c, p: F.count_if(c.isNull()).cast("double"), description="NULL values"),
    Metric("DUPLICATE_COUNT", "column", ("ALL",), "distinct",
           description="non-NULL values beyond the first copy of each value"),
    Metric("UNIQUE_COUNT", "column", ("ALL",), "distinct",
           description="distinct non-NULL values"),
    Metric("DUPLICATE_VALUES", "column", ("ALL",), "distinct",
           description="distinct non-NULL values that occur more than once"),
    Metric("NULL_PERCENT", "column", ("ALL",), "scan", _null_percent,
           description="percent of rows that are NULL (NULL for an empty table)"),
    Metric("ACCEPTED_VALUES", "column", ("ALL",), "scan", _accepted,
           description="non-NULL values outside the accepted set"),
    Metric("AVG", "column", NUMERIC_TYPE_NAMES, "scan",
           lambda c, p: F.avg(c).cast("double"), accepts=_is_numeric, description="mean"),
    Metric("MIN", "column", NUMERIC_TYPE_NAMES, "scan",
           lambda c, p: F.min(c).cast("double"), accepts=_is_numeric, description="minimum"),
    Metric("MAX", "column", NUMERIC_TYPE_NAMES, "scan",
           lambda c, p: F.max(c).cast("double"), accepts=_is_numeric, description="maximum"),
    Metric("STDDEV", "column", NUMERIC_TYPE_NAMES, "scan",
           lambda c, p: F.stddev_samp(c).cast("double"), accepts=_is_numeric,
           description="sample standard deviation"),
):
    register_metric(_m)

# the five metrics the reference configures in code; the rest are the documented ones
CORE_METRICS = ("ROW_COUNT", "FRESHNESS", "NULL_COUNT", "DUPLICATE_COUNT", "UNIQUE_COUNT")

"""Configuration frames: small tables built from Python values (policies, selections).

They are built as local relations (through Arrow): the rows travel inside the plan, the
planner has exact size statistics, and a broadcast of them needs no Spark job. Their
size is known when they are built, so they also carry a broadcast hint -- but only
below ``max_rows`` and ``BROADCAST_MAX_BYTES``; beyond them they are left to the planner.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 8 << 20


def config_frame(spark: SparkSession, rows: list, schema, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``rows`` of Python values -> DataFrame with ``schema`` (DDL string or StructType).

    None becomes NULL (a float NaN does too: config values are never NaN)."""
    st = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    names = [f.name for f in st.fields]
    pdf = pd.DataFrame([list(r) for r in rows], columns=names, dtype=object)
    df = spark.createDataFrame(pdf, st)
    small = len(rows) <= max_rows and pdf.memory_usage(deep=True).sum() <= BROADCAST_MAX_BYTES
    return F.broadcast(df) if small else df

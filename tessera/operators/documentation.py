"""The documentation job as one call: suggestions for the objects of a schema in the session
catalog, written once, applied as comments and logged (D3, K1, K5, K6, A16)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.canonical import is_nested
from tessera.operators import describe as D
from tessera.operators.catalog import columns_listing, objects_listing
from tessera.operators.history import description_change_rows, with_history_id
from tessera.session import scratch_path, unique_name
from tessera.sinks.comments import ApplyReport, apply_suggestions
from tessera.sinks.tables import log_run
from tessera.sources.catalog import session_columns, session_objects

CATALOG = "spark_catalog"


@dataclass
class Documented:
    """What a run suggested (as stored), what was applied, and the log it wrote to."""

    suggestions: DataFrame
    report: ApplyReport
    log_path: str


def store_once(suggestions: DataFrame, location: str, run_id: str, group: int = 0) -> None:
    """Write a run's suggestions (of one group of objects): a completer answers once per
    object, and what is applied, logged and counted is the same text. A retried run replaces
    its own."""
    suggestions.write.mode("overwrite").parquet(f"{location}/suggestions/{run_id}/group={group}")


def _sample_key(df: DataFrame) -> str | None:
    """The first column of a plain type, by which rows are sampled."""
    return next((f.name for f in df.schema.fields if not is_nested(f.dataType)), None)


def _samples(spark: SparkSession, schema: str, names: list[str], database: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Sample rows and sample values of the named tables; a table that has no plain column or
    can't be read has none."""
    rows, values = [], []
    for name in names:
        try:
            df = spark.table(f"`{schema}`.`{name.replace('`', '``')}`")
            key = _sample_key(df)
        except Exception:
            continue
        if key is not None:
            rows.append(D.sample_rows(df, name, key, database=database, schema=schema))
            values.append(D.column_samples(df, name, key, database=database, schema=schema))
    if not rows:
        return None, None
    return D.sample_text(reduce(lambda a, b: a.unionByName(b), rows)), reduce(lambda a, b: a.unionByName(b), values)


#: Objects whose suggestions come from one job: no plan holds more.
OBJECTS_PER_JOB = 50


def document_schema(spark: SparkSession, schema: str, generation_type: str = "BOTH", tables=None,
                    completer: Callable[[pd.Series], pd.Series] | None = None, updated_by=None, updated_at=None,
                    location: str | None = None, run_id: str | None = None, database: str = CATALOG) -> Documented:
    """Describe the readable tables and views of a schema (all, or those in ``tables``, in any
    case), apply the texts as comments and log the changes. Prompts hold sample rows and
    values of the objects.

    The four input rules raise ``ValueError``. A failed or empty completion changes nothing
    and is counted; so is a selected name that the schema lacks (a row of kind ``MISSING``
    with its error). ``location`` is a shared folder for suggestions and the audit log;
    calling again with the same ``run_id`` replaces that run's rows.
    """
    wrong = D.validate_request(database, schema, tables, generation_type)
    if wrong:
        raise ValueError(wrong)
    run_id = run_id or unique_name("run")
    location = location or scratch_path(spark, "documentation", unique_name("documentation"))
    listed = objects_listing(session_objects(spark, schema), sort=False).withColumnRenamed("object_name", "table_name")
    # metadata of one schema: names for the catalog calls
    names = sorted(r["table_name"] for r in listed.select("table_name").collect())
    missing = []
    if tables is not None:
        asked, known = {t.upper(): t for t in tables}, {n.upper() for n in names}
        names = [n for n in names if n.upper() in asked]
        missing = [t for u, t in asked.items() if u not in known]
    groups = [names[a:a + OBJECTS_PER_JOB] for a in range(0, len(names), OBJECTS_PER_JOB)] or [[]]
    for i, group in enumerate(groups):
        columns = columns_listing(session_columns(spark, schema, *group), sort=False)
        rows, values = _samples(spark, schema, group, database)
        found = D.generate_descriptions(listed.where(F.col("table_name").isin(group)), columns, generation_type, rows, values,
                                        completer=completer)
        if i == 0 and missing:
            found = found.unionByName(spark.createDataFrame(
                [("MISSING", database, schema, t, None, None, None, f"no table or view {t} in {schema}") for t in missing],
                found.schema))
        store_once(found, location, run_id, i)
    stored = spark.read.schema(found.schema).parquet(*[f"{location}/suggestions/{run_id}/group={i}" for i in range(len(groups))])
    report = apply_suggestions(spark, stored.withColumn("table_ident", F.array("schema_name", "table_name")))
    log_path = f"{location}/description_history"
    log_run(with_history_id(description_change_rows(D.suggestion_changes(stored), updated_by, updated_at)),
            log_path, run_id)
    return Documented(stored, report, log_path)

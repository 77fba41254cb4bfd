"""Samples that run with their query, the documentation job over a selection, views elsewhere."""

import pandas as pd
import pytest

from tessera.operators import describe as D
from tessera.operators.documentation import document_schema
from tessera.session import scratch_path, unique_name
from tessera.sinks import comments as C


@pytest.fixture
def schema(spark):
    name = unique_name("documented")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'catalog', name)}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def _jobs(spark, build):
    """How many jobs ``build`` starts, and what it returns."""
    group = unique_name("group")
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_samples_run_with_their_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for build in (lambda: D.sample_rows(docs, "documents", "doc_id"), lambda: D.column_samples(docs, "documents", "doc_id")):
        n, frame = _jobs(spark, build)
        assert n == 0 and frame.count() > 0
    plan = D.sample_rows(docs, "documents", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "TakeOrderedAndProject" in plan


def test_samples_with_null_and_repeated_keys(spark):
    rows = [(None, "b", {"k": 1}), (None, "a", {"k": 2}), (1, "z", None), (1, "y", {"k": 0}), (1, "y", {"j": 0}), (2, "q", None)]
    df = spark.createDataFrame(rows, "id int, s string, m map<string,int>").repartition(3)
    got = [r["row_text"] for r in D.sample_rows(df, "t", "id", n=4).orderBy("rn").collect()]
    assert got == ["NULL | a | {k -> 2}", "NULL | b | {k -> 1}", "1 | y | {j -> 0}", "1 | y | {k -> 0}"]
    assert D.sample_rows(df.where("id IS NULL"), "t", "id").count() == 2
    assert D.sample_rows(df.limit(0), "t", "id").count() == 0
    values = D.column_samples(df, "t", ["id", "s"], ["m"], n=10).collect()
    assert len(values) == 6 and {r["column_name"] for r in values} == {"m"}


def test_prompts_of_the_job_hold_samples(spark, schema):
    spark.sql(f"CREATE TABLE {schema}.t USING parquet AS SELECT id AS n, concat('row ', id) AS s, array(id) AS a FROM range(3)")
    spark.sql(f"CREATE TABLE {schema}.only_nested USING parquet AS SELECT array(id) AS a FROM range(3)")
    spark.sql(f"CREATE VIEW {schema}.v AS SELECT n FROM {schema}.t")
    spark.sql(f"CREATE TABLE {schema}.other USING parquet AS SELECT 1 AS x")
    run = document_schema(spark, schema, completer=lambda prompts: pd.Series(prompts.str.replace("\n", "~")),
                          tables=["T", "V", "only_nested", "gone", "GONE"])
    texts = {(r["table_name"], r["column_name"]): r for r in run.suggestions.collect()}
    assert "example rows:~0 | row 0 | [0]~1 | row 1 | [1]" in texts["t", None]["description"]
    assert "example rows:~0~1~2~" in texts["v", None]["description"]
    assert "example values:~" in texts["t", "s"]["description"] and "row 2" in texts["t", "s"]["description"]
    assert D.NO_SAMPLE in texts["only_nested", None]["description"]
    assert ("other", None) not in texts
    missing = [r for r in texts.values() if r["kind"] == "MISSING"]
    assert len(missing) == 1 and missing[0]["description"] is None and "no table or view" in missing[0]["error"]
    summary = D.run_summary(run.suggestions).first()
    assert (summary["tables_processed"], summary["failed"]) == (3, 1)
    assert any("GONE" in name.upper() for name, _ in run.report.failed)


def test_a_schema_of_many_objects_is_several_jobs(spark, schema, monkeypatch):
    from tessera.operators import documentation
    monkeypatch.setattr(documentation, "OBJECTS_PER_JOB", 2)
    for i in range(5):
        spark.sql(f"CREATE TABLE {schema}.t{i} USING parquet AS SELECT {i} AS x")
    run = document_schema(spark, schema, "TABLE", run_id="once")
    assert run.suggestions.count() == 5 and not run.report.failed
    assert document_schema(spark, schema, tables=["none"]).suggestions.collect()[0]["kind"] == "MISSING"


def test_a_view_keeps_what_it_was_created_under(spark, schema):
    """Settings, namespace, properties and comment of a view survive, and those of the session."""
    spark.sql(f"USE {schema}")
    try:
        spark.sql("CREATE TABLE t USING parquet AS SELECT '2024-01-01 00:00:00' AS s")
        zone = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        spark.sql("CREATE VIEW v COMMENT 'old' TBLPROPERTIES ('a.b' = 'c\\\\d') AS SELECT unix_timestamp(CAST(s AS TIMESTAMP)) AS u FROM t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.sql("USE default")
    before = spark.table(f"{schema}.v").first()[0]
    report = C.recreate_view(spark, f"{schema}.v", {"U": "seconds"})
    assert not report.failed and spark.table(f"{schema}.v").first()[0] == before == 1704067200 - 9 * 3600
    assert spark.conf.get("spark.sql.session.timeZone") == zone and spark.catalog.currentDatabase() == "default"
    assert C._properties(spark, f"{schema}.v")["a.b"] == "c\\d"
    assert C._details(spark, f"{schema}.v")["Comment"] == "old"
    assert spark.table(f"{schema}.v").schema["u"].metadata["comment"] == "seconds"
    # a failing statement puts the session back, too
    with pytest.raises(ZeroDivisionError):
        with C.created_under(spark, {"view.sqlConfig.spark.sql.session.timeZone": "Asia/Tokyo"}):
            raise ZeroDivisionError
    assert spark.conf.get("spark.sql.session.timeZone") == zone

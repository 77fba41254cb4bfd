"""Catalog comment sinks (K5, K6), readable-view probe (F12), log appends and exports."""

import os

from pyspark.sql import functions as F

from tessera.sinks import comments as C
from tessera.sinks.tables import append_and_read, export_csv, read_csv, with_hash_id
from tessera.session import scratch_path, unique_name


def test_failed_suggestion_erases_nothing(spark):
    from tessera.sinks.comments import apply_suggestions
    spark.sql("CREATE TABLE keep_comment (a INT COMMENT 'old a') USING parquet COMMENT 'old t'")
    rows = spark.createDataFrame([("keep_comment", None, None), ("keep_comment", "a", " "), ("keep_comment", None, "new t")],
                                 "table_ident string, column_name string, description string")
    report = apply_suggestions(spark, rows)
    assert (report.succeeded, len(report.failed)) == (1, 2)
    assert spark.table("keep_comment").schema["a"].metadata["comment"] == "old a"
    assert spark.catalog.getTable("keep_comment").description == "new t"


def test_view_column_may_be_called_comment(spark):
    from tessera.sinks.comments import recreate_view
    spark.sql("CREATE TABLE base_for_view (Comment STRING, Type STRING) USING parquet")
    spark.sql("CREATE VIEW view_with_comment (Comment, Type) COMMENT 'kept' AS SELECT * FROM base_for_view")
    recreate_view(spark, "view_with_comment", {"Type": "kind"})
    assert spark.catalog.getTable("view_with_comment").description == "kept"


def test_csv_keeps_texts(spark):
    from tessera.sinks.tables import export_csv, read_csv
    texts = ['a "quoted" text', "two\nlines, one comma", "", None, " spaces "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    path = export_csv(df, scratch_path(spark, "exports", unique_name("texts")))
    assert [r.t for r in read_csv(spark, path, df.schema).orderBy("id").collect()] == texts
from tessera.sources.catalog import readable, schema_columns, session_columns, session_objects


def _comment(spark, table, column):
    for r in spark.sql(f"DESCRIBE TABLE {table}").collect():
        if r[0] == column:
            return r[2]


def test_table_and_column_comments(spark):
    spark.sql("DROP TABLE IF EXISTS tq_t")
    spark.range(3).withColumn("name", F.lit("x")).write.saveAsTable("tq_t")
    sugg = spark.createDataFrame([("tq_t", None, "It's a table"), ("tq_t", "name", "the name"),
                                  ("tq_t", "missing", "nope")],
                                 "table_ident string, column_name string, description string")
    rep = C.apply_suggestions(spark, sugg)
    assert rep.succeeded == 2 and len(rep.failed) == 1
    assert _comment(spark, "tq_t", "name") == "the name"
    info = {r[0]: r[1] for r in spark.sql("DESCRIBE TABLE EXTENDED tq_t").collect()}
    assert info["Comment"] == "It's a table"
    objs = {r.table_name: r for r in session_objects(spark, "default").collect()}
    assert objs["tq_t"].comment == "It's a table"
    cols = {r.column_name: r for r in session_columns(spark, "default", "tq_t").collect()}
    assert cols["name"].comment == "the name" and cols["id"].ordinal_position == 1


def test_view_recreated_with_comments(spark):
    spark.sql("DROP VIEW IF EXISTS tq_v")
    spark.sql("DROP TABLE IF EXISTS tq_base")
    spark.range(3).withColumn("b", F.lit(1)).withColumn("c", F.lit(2)).write.saveAsTable("tq_base")
    spark.sql("CREATE VIEW tq_v (id, b COMMENT 'keep me', c COMMENT 'old c') AS "
              "SELECT id, b, c FROM tq_base WHERE (id > 0)")
    sugg = spark.createDataFrame([("tq_v", "ID", "the id"), ("tq_v", "c", ""), ("tq_v", None, "a view")],
                                 "table_ident string, column_name string, description string")
    rep = C.apply_suggestions(spark, sugg)
    assert rep.failed == [], rep.failed
    assert _comment(spark, "tq_v", "id") == "the id"
    assert _comment(spark, "tq_v", "b") == "keep me"
    assert _comment(spark, "tq_v", "c") is None            # new but empty -> none
    assert spark.table("tq_v").count() == 2                 # view text kept whole, ')' included


def test_unreadable_view_is_skipped(spark):
    spark.sql("DROP VIEW IF EXISTS tq_broken")
    spark.sql("DROP TABLE IF EXISTS tq_gone")
    spark.range(2).write.saveAsTable("tq_gone")
    spark.sql("CREATE VIEW tq_broken AS SELECT id FROM tq_gone")
    spark.sql("DROP TABLE tq_gone")
    assert not readable(spark, "default.tq_broken")
    names = {r.table_name for r in session_objects(spark, "default").collect()}
    assert "tq_broken" not in names


def test_schema_columns(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = schema_columns(df, "embeddings", "DB", "S").collect()
    assert [r.data_type for r in rows] == ["BIGINT", "ARRAY<FLOAT>", "INT"]
    assert [r.ordinal_position for r in rows] == [1, 2, 3]


def test_append_is_additive_and_ids_are_stable(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    a = with_hash_id(df, "id", ["k", "v"]).collect()
    b = with_hash_id(df, "id", ["k", "v"]).collect()
    assert [r.id for r in a] == [r.id for r in b] and len({r.id for r in a}) == 2
    out = append_and_read(df, "unit_log")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1), ("b", 2)]


def test_csv_roundtrip_keeps_nulls_and_micros(spark):
    df = spark.sql("SELECT 'x' AS a, CAST(NULL AS STRING) AS b, "
                   "TIMESTAMP_NTZ'2024-01-01 00:00:00.123456' AS t")
    path = scratch_path(spark, "exports", unique_name("unit"))
    export_csv(df, path)
    back = read_csv(spark, path, df.schema).collect()[0]
    assert back.b is None and back.t.microsecond == 123456


def test_periodic_trigger_starts(spark, sf_dir):
    from tessera.streaming import windows as W
    s = W.file_stream(spark, sf_dir, "events")
    out = scratch_path(spark, "streams", unique_name("periodic"))
    q = W.start_periodic(W.stream_window_metrics(s, "ts", "value", "1 day", "1 hour"),
                         out + "/data", out + "/ckpt", every="1 second")
    try:
        q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()
    assert spark.read.parquet(out + "/data").count() > 0


def test_size_shuffle_partitions(spark, sf_dir):
    import os
    from tessera.session import size_shuffle_partitions
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        b = os.path.getsize(f"{sf_dir}/lineitem.parquet")
        assert size_shuffle_partitions(spark, 100 * (1 << 40), minimum=8) == 409600   # 100 TiB / 256 MiB
        assert size_shuffle_partitions(spark, b, minimum=8) == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_file_stream_reads_directory_tables(spark, sf_dir):
    from tessera.streaming import windows as W
    root = scratch_path(spark, "tables", unique_name("dir_layout"))
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{root}/events.parquet")
    a = W.run_available(W.stream_window_metrics(W.file_stream(spark, root, "events"),
                                                "ts", "value", "1 day", "1 hour"), "dir").collect()
    b = W.run_available(W.stream_window_metrics(W.file_stream(spark, sf_dir, "events"),
                                                "ts", "value", "1 day", "1 hour"), "file").collect()
    key = lambda r: r.window_start
    assert [(r.window_start, r.row_count) for r in sorted(a, key=key)] == \
           [(r.window_start, r.row_count) for r in sorted(b, key=key)]


def test_measure_checks_on_catalog_tables(spark):
    from tessera.operators.metrics import measure_checks, measure_checks_in_jobs
    spark.sql("DROP TABLE IF EXISTS tq_m")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, s string").write.saveAsTable("tq_m")
    checks = spark.createDataFrame(
        [("spark_catalog", "default", "tq_m", "ROW_COUNT", None),
         ("spark_catalog", "default", "tq_m", "DUPLICATE_COUNT", "s"),
         ("spark_catalog", "default", "tq_m", "NULL_COUNT", "s"),
         ("spark_catalog", "default", "missing_table", "ROW_COUNT", None)],
        "table_catalog string, table_schema string, table_name string, metric_name string, column_name string")
    got = {(r.table_name, r.column_name, r.metric_name): r.value for r in measure_checks(spark, checks).collect()}
    assert got[("spark_catalog.default.tq_m", None, "ROW_COUNT")] == 3
    assert got[("spark_catalog.default.tq_m", "s", "DUPLICATE_COUNT")] == 1
    assert got[("spark_catalog.default.tq_m", "s", "NULL_COUNT")] == 1
    assert got[("spark_catalog.default.missing_table", None, "ROW_COUNT")] is None
    jobs = list(measure_checks_in_jobs(spark, checks, tables_per_job=1))
    assert len(jobs) == 2 and sum(j.count() for j in jobs) == 4


def test_view_description_only_is_a_property_change(spark):
    spark.sql("DROP VIEW IF EXISTS tq_v2")
    spark.sql("DROP TABLE IF EXISTS tq_base2")
    spark.range(2).write.saveAsTable("tq_base2")
    spark.sql("CREATE VIEW tq_v2 (id COMMENT 'kept') AS SELECT id FROM tq_base2")
    sugg = spark.createDataFrame([("tq_v2", None, "just the view")],
                                 "table_ident string, column_name string, description string")
    rep = C.apply_suggestions(spark, sugg)
    assert rep.failed == [] and rep.succeeded == 1
    info = {r[0]: r[1] for r in spark.sql("DESCRIBE TABLE EXTENDED tq_v2").collect()}
    assert info.get("Comment") == "just the view"
    assert _comment(spark, "tq_v2", "id") == "kept"


def test_rerun_of_a_run_replaces_its_partition(spark):
    from tessera.sinks.tables import write_run
    path = scratch_path(spark, "results", unique_name("rerun"))
    run1 = spark.createDataFrame([("2024-01-01", "r1", 1.0), ("2024-01-01", "r1", 2.0)],
                                 "measurement_date string, run_id string, v double")
    run2 = spark.createDataFrame([("2024-01-02", "r2", 3.0)], "measurement_date string, run_id string, v double")
    write_run(run1, path, ["measurement_date", "run_id"])
    write_run(run2, path, ["measurement_date", "run_id"])
    write_run(run1, path, ["measurement_date", "run_id"])          # re-run after a failure
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 3.0]


def test_python_workers_need_no_installed_package(tmp_path):
    """From another working directory, a mapInPandas completer still runs: package code is
    pickled by value to the Python workers."""
    import subprocess
    import sys as _sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', E.queries()['describe_columns_pandas'](spark, '/root/testdata/sf0.001').count())\n"
    ) % root
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([_sys.executable, "-c", script], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS " in out.stdout, out.stderr[-2000:]

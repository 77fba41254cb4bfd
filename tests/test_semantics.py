"""Hand-made frames for the pinned semantics: NULLs, blanks, quotes, empty tables,
failure isolation, properties between metrics."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions import text as X
from tessera.operators import describe as D
from tessera.operators import history as H
from tessera.operators import monitor as M
from tessera.operators.metrics import Check, measure, measure_expand


def _vals(df):
    return {(r.column_name, r.metric_name): r.value for r in df.collect()}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, "a", 1.0, dt.date(2024, 1, 1)), (2, "a", None, dt.date(2024, 1, 2)),
            (3, "b", 3.0, None), (4, None, float("nan"), dt.date(2024, 1, 3)),
            (5, "c", 3.0, dt.date(2024, 1, 3))]
    return spark.createDataFrame(rows, "id long, s string, x double, d date")


def test_metric_properties(frame):
    checks = [Check("ROW_COUNT")] + [Check(m, c) for c in ("s", "x", "d")
                                     for m in ("NULL_COUNT", "UNIQUE_COUNT", "DUPLICATE_COUNT")]
    v = _vals(measure(frame, checks, "t"))
    n = v[(None, "ROW_COUNT")]
    assert n == 5
    nonnull = {"s": 4, "x": 4, "d": 4}
    for c, cnt in nonnull.items():
        assert v[(c, "NULL_COUNT")] + cnt == n
        assert v[(c, "UNIQUE_COUNT")] + v[(c, "DUPLICATE_COUNT")] == cnt
    assert v[("s", "UNIQUE_COUNT")] == 3 and v[("s", "DUPLICATE_COUNT")] == 1


def test_union_form_equals_expand_form(frame):
    checks = [Check("ROW_COUNT"), Check("NULL_COUNT", "s"), Check("UNIQUE_COUNT", "s"),
              Check("DUPLICATE_COUNT", "s"), Check("UNIQUE_COUNT", "d"), Check("AVG", "id")]
    a, b = _vals(measure(frame, checks, "t")), _vals(measure_expand(frame, checks, "t"))
    assert a == b


def test_row_order_invariance(frame):
    checks = [Check("UNIQUE_COUNT", "s"), Check("DUPLICATE_VALUES", "s"), Check("MIN", "id")]
    a = _vals(measure(frame, checks, "t"))
    b = _vals(measure(frame.orderBy(F.rand(7)).repartition(3), checks, "t"))
    assert a == b


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, ts timestamp")
    checks = [Check("ROW_COUNT"), Check("NULL_PERCENT", "id"), Check("FRESHNESS", "ts"),
              Check("UNIQUE_COUNT", "id"), Check("DUPLICATE_COUNT", "id"), Check("STDDEV", "id")]
    v = _vals(measure(df, checks, "t", as_of="2024-01-01 00:00:00"))
    assert v[(None, "ROW_COUNT")] == 0
    assert v[("id", "NULL_PERCENT")] is None
    assert v[("ts", "FRESHNESS")] is None
    assert v[("id", "UNIQUE_COUNT")] == 0 and v[("id", "DUPLICATE_COUNT")] == 0
    assert v[("id", "STDDEV")] is None


def test_freshness_on_date_is_midnight_utc(frame):
    v = _vals(measure(frame, [Check("FRESHNESS", "d")], "t", as_of="2024-01-04 00:00:10"))
    assert v[("d", "FRESHNESS")] == 86410


def test_one_row_stddev_and_all_null(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    v = _vals(measure(df, [Check("STDDEV", "a"), Check("NULL_PERCENT", "b"),
                           Check("UNIQUE_COUNT", "b"), Check("DUPLICATE_VALUES", "b")], "t"))
    assert v[("a", "STDDEV")] is None
    assert v[("b", "NULL_PERCENT")] == 100.0
    assert v[("b", "UNIQUE_COUNT")] == 0 and v[("b", "DUPLICATE_VALUES")] == 0


def test_nan_counts_as_a_value(frame):
    v = _vals(measure(frame, [Check("NULL_COUNT", "x"), Check("UNIQUE_COUNT", "x")], "t"))
    assert v[("x", "NULL_COUNT")] == 1
    assert v[("x", "UNIQUE_COUNT")] == 3        # 1.0, 3.0, NaN


def test_accepted_values(frame):
    v = _vals(measure(frame, [Check("ACCEPTED_VALUES", "s", (("values", ("a",)),))], "t"))
    assert v[("s", "ACCEPTED_VALUES")] == 2      # b, c (NULL is not counted)


def test_failure_isolation(frame):
    checks = [Check("ROW_COUNT"), Check("NULL_COUNT", "nope"), Check("AVG", "s"),
              Check("NO_SUCH_METRIC", "s"), Check("FRESHNESS", "id")]
    v = _vals(measure(frame, checks, "t"))
    assert v[(None, "ROW_COUNT")] == 5
    assert v[("nope", "NULL_COUNT")] is None
    assert v[("s", "AVG")] is None
    assert v[("s", "NO_SUCH_METRIC")] is None
    assert v[("id", "FRESHNESS")] is None


def test_duplicate_checks_are_measured_once(frame):
    out = measure(frame, [Check("FRESHNESS", "d"), Check("FRESHNESS", "d")], "t", as_of="2024-02-01")
    assert out.count() == 1


def test_array_column_distinct(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), (None,)], "a array<int>")
    v = _vals(measure(df, [Check("UNIQUE_COUNT", "a"), Check("DUPLICATE_COUNT", "a"),
                           Check("NULL_COUNT", "a")], "t"))
    assert (v[("a", "UNIQUE_COUNT")], v[("a", "DUPLICATE_COUNT")], v[("a", "NULL_COUNT")]) == (1, 1, 1)


def test_approx_distinct_close(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = _vals(measure(df, [Check("UNIQUE_COUNT", "l_orderkey")], "l"))
    approx = _vals(measure(df, [Check("UNIQUE_COUNT", "l_orderkey")], "l", distinct="approx"))
    e, a = exact[("l_orderkey", "UNIQUE_COUNT")], approx[("l_orderkey", "UNIQUE_COUNT")]
    assert abs(a - e) / e < 0.1


def _one(spark, col_expr, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(col_expr(F.col("v"))).collect()]


def test_quote_identifier(spark):
    vals = [None, "", '"x y"', '"', "a b", "Table", "ok_name", "a-b", "x.y", "f(x)", "Brand#1"]
    out = _one(spark, N.quote_identifier, vals)
    assert out == [None, "", '"x y"', '"', '"a b"', '"Table"', "ok_name", '"a-b"', '"x.y"',
                   '"f(x)"', "Brand#1"]


def test_parse_statement(spark):
    ns = N.METRIC_NAMESPACE
    stmts = [f'ALTER TABLE DB.S.T ADD DATA METRIC FUNCTION {ns}.ROW_COUNT ON ();',
             f'alter table db.s."my t" add data metric function {ns.lower()}.null_count ON ("c 1");',
             f"ALTER TABLE T ADD DATA METRIC FUNCTION {ns}.UNIQUE_COUNT ON ( 'c' );",
             "something else"]
    out = _one(spark, N.parse_metric_statement, stmts)
    assert tuple(out[0]) == ("T", "ROW_COUNT", None)
    assert tuple(out[1]) == ("UNKNOWN_TABLE", "NULL_COUNT", "c 1")
    assert tuple(out[2]) == ("T", "UNIQUE_COUNT", "c")
    assert tuple(out[3]) == ("UNKNOWN_TABLE", "UNKNOWN_DMF", None)


def test_clean_generated(spark):
    out = _one(spark, X.clean_generated, ['"', '  "abc"\n', '""', 'a"', '\t x \r', None])
    assert out == ['"', "abc", "", 'a"', "x", None]


def test_description_flags(spark):
    vals = [None, "", "  ", "\t\n", "null", "NULL", "x"]
    assert _one(spark, X.has_description, vals) == ["No", "No", "No", "No", "Yes", "Yes", "Yes"]
    assert _one(spark, X.column_description, vals) == [None, None, "  ", "\t\n", None, None, "x"]
    assert _one(spark, lambda c: X.has_description(X.column_description(c)), vals) == \
        ["No", "No", "No", "No", "No", "No", "Yes"]
    assert _one(spark, X.object_description, vals) == [None, None, "  ", "\t\n", "null", "NULL", "x"]


def test_search_regex_and_literal(spark):
    df = spark.createDataFrame([("Orders",), ("ORD.X",), (None,), ("ordxx",)], "n string")
    assert {r.n for r in df.filter(X.search_match("n", "^ord.x")).collect()} == {"ORD.X", "ordxx"}
    assert {r.n for r in df.filter(X.search_match("n", "ord.x", literal=True)).collect()} == {"ORD.X"}


def test_split_last_dot(spark):
    df = spark.createDataFrame([("a.b.c",), ("t",)], "n string")
    head, tail = N.split_last_dot(F.col("n"))
    assert [tuple(r) for r in df.select(head, tail).collect()] == [("a.b", "c"), ("t", None)]


def test_status_rules(spark):
    df = spark.createDataFrame([(None, 0.0, 1.0), (5.0, None, None), (5.0, 1.0, None), (5.0, None, 4.0),
                                (1.0, 1.0, 1.0)], "v double, lo double, hi double")
    out = [r[0] for r in df.select(M.status_expr(F.col("v"), F.col("lo"), F.col("hi"))).collect()]
    assert out == ["UNKNOWN", "MEASURED", "PASS", "FAIL", "PASS"]


def test_monitor_summary_keeps_null_column_and_takes_newest(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [(1, "ROW_COUNT", "D", "S", "T", None, "PASS", t1, t1),
            (2, "ROW_COUNT", "D", "S", "T", None, "FAIL", t2, t2),
            (3, "NULL_COUNT", "D", "S", "T", "C", "PASS", t2, t2),
            (4, "NULL_COUNT", "D", "S", "T", "C", "UNKNOWN", t2, t2)]
    df = spark.createDataFrame(rows, "result_id long, monitor_name string, database_name string, "
                               "schema_name string, table_name string, column_name string, status string, "
                               "measurement_time timestamp, record_inserted_at timestamp")
    mon = {(r.column_name, r.monitor_type): r for r in M.monitor_summary(df).collect()}
    assert mon[(None, "ROW_COUNT")].last_status == "FAIL"
    assert mon[(None, "ROW_COUNT")].first_seen == t1
    assert mon[("C", "NULL_COUNT")].last_status == "UNKNOWN"    # same time: higher id wins
    ts = M.table_summary(M.monitor_summary(df)).collect()[0]
    assert ts.monitor_types == "NULL_COUNT, ROW_COUNT"
    assert ts.columns_monitored == 1 and ts.overall_status == "MIXED"


def test_description_change_rows(spark):
    changes = spark.createDataFrame(
        [("D", "S", "t.c.x", "COLUMN", "", "it's new"), ("D", "S", "my table", "TABLE", None, "d"),
         ("D", "S", "v", "VIEW", "old", "")],
        "database_name string, schema_name string, object_name string, object_type string, "
        "before_description string, after_description string")
    rows = H.description_change_rows(changes, "u", "2024-01-01 00:00:00").collect()
    col, tab, view = rows
    assert (col.object_name, col.column_name, col.before_description) == ("t.c", "x", None)
    assert col.sql_executed == 'COMMENT ON COLUMN D.S."t.c".x IS \'it\'\'s new\';'
    assert tab.sql_executed == "COMMENT ON TABLE D.S.\"my table\" IS 'd';"
    assert view.sql_executed == "-- VIEW description update" and view.after_description is None


def test_contact_change_rows_skip_empty(spark):
    ch = spark.createDataFrame([("D", "S", "T", "STEWARD", "None", "a.b.\"c\""),
                                ("D", "S", "T", "SUPPORT", "x", "")],
                               "database_name string, schema_name string, table_name string, "
                               "purpose string, old_contact string, new_contact string")
    rows = H.contact_change_rows(ch).collect()
    assert len(rows) == 1 and rows[0].before_description is None
    assert rows[0].object_type == "CONTACT_STEWARD"


def test_completer_failure_isolation(spark):
    prompts = spark.createDataFrame([("ok 1",), ("BAD",), ("ok 2",)], "prompt string").coalesce(1)

    def completer(s: pd.Series) -> pd.Series:
        if s.str.contains("BAD").any():
            raise RuntimeError("model unavailable")
        return "desc: " + s

    rows = {r.prompt: r for r in D.complete_with(prompts, completer).collect()}
    assert rows["ok 1"].description == "desc: ok 1" and rows["ok 1"].error is None
    assert rows["BAD"].description is None and "unavailable" in rows["BAD"].error


def test_merge_column_comments(spark):
    keys = "database_name string, schema_name string, table_name string, column_name string"
    cur = spark.createDataFrame([("D", "S", "T", "A", "old a"), ("D", "S", "T", "B", "old b"),
                                 ("D", "S", "T", "C", "  "), ("D", "S", "T", "E", None)],
                                keys + ", current_description string")
    new = spark.createDataFrame([("D", "S", "T", "a", "new a"), ("D", "S", "T", "b", "")],
                                keys + ", description string")
    out = {r.column_name: r.comment for r in D.merge_column_comments(cur, new).collect()}
    assert out == {"A": "new a", "B": None, "C": None, "E": None}


def test_validate_request():
    assert D.validate_request("", "s", ["t"], "TABLE") == "no database given"
    assert D.validate_request("d", "", ["t"], "TABLE") == "no schema given"
    assert D.validate_request("d", "s", [], "TABLE") == "the list of tables has no entry"
    assert D.validate_request("d", "s", ["t"], "both") is None
    assert "TABLE, COLUMN, BOTH" in D.validate_request("d", "s", ["t"], "ALL")


def test_merged_partials_equal_direct(spark, sf_dir):
    from tessera.streaming import windows as W
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = W.partials(ev, "ts", "value", ["event_type"])
    m = {r.event_type: r for r in W.merge_partials(parts, ["event_type"], "2024-01-05", "2024-01-20").collect()}
    d = ev.filter((F.to_date("ts") >= "2024-01-05") & (F.to_date("ts") <= "2024-01-20")) \
          .groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"),
                                     F.max("value").alias("mx")).collect()
    for r in d:
        assert m[r.event_type].n == r.n and m[r.event_type].value_max == r.mx
        assert math.isclose(m[r.event_type].value_sum, r.s, rel_tol=1e-12)


def test_accepted_values_domain_join_equals_in_list(spark, sf_dir):
    from tessera.operators import metrics as MM
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    vals = [str(i) for i in range(1005)] + ["R"]
    big = _vals(measure(df, [Check("ACCEPTED_VALUES", "l_returnflag", (("values", tuple(vals)),))], "l"))
    small = _vals(measure(df, [Check("ACCEPTED_VALUES", "l_returnflag", (("values", ("R",)),))], "l"))
    assert big == small
    dom = spark.createDataFrame([("R",), ("A",)], "x string")
    viadf = _vals(measure(df, [Check("ACCEPTED_VALUES", "l_returnflag", (("domain", dom),))], "l"))
    inl = _vals(measure(df, [Check("ACCEPTED_VALUES", "l_returnflag", (("values", ("R", "A")),))], "l"))
    assert viadf == inl


def test_materialized_source_gives_same_results(spark, sf_dir):
    from tessera.sources.fixtures import labeled_documents
    d = labeled_documents(spark, sf_dir)
    checks = [Check("ROW_COUNT"), Check("NULL_COUNT", "quality"), Check("UNIQUE_COUNT", "text"),
              Check("DUPLICATE_COUNT", "lang")]
    assert _vals(measure(d, checks, "d")) == _vals(measure(d, checks, "d", materialize=True))


def test_time_range_prunes_date_partitions(spark):
    from tessera.sinks.tables import append_and_read
    rows = [(1, dt.datetime(2024, 1, 1, 5)), (2, dt.datetime(2024, 1, 30, 5))]
    df = spark.createDataFrame(rows, "result_id long, measurement_time timestamp") \
        .withColumn("measurement_date", F.to_date("measurement_time"))
    back = append_and_read(df, "unit_results", partition_by=["measurement_date"])
    out = M.time_range(back, "7d", "2024-01-31 00:00:00")
    assert [r.result_id for r in out.collect()] == [2]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "measurement_date" in plan


def test_stream_approx_distinct_close(spark, sf_dir):
    from tessera.streaming import windows as W
    s = W.file_stream(spark, sf_dir, "events")
    ex = {r.window_start: r for r in W.run_available(
        W.stream_distinct_counts(s, "ts", "user_id", "1 day", "1 hour"), "ex").collect()}
    ap = W.run_available(W.stream_distinct_counts(s, "ts", "user_id", "1 day", "1 hour", exact=False),
                         "ap").collect()
    assert len(ap) == len(ex)
    for r in ap:
        e = ex[r.window_start].unique_count
        assert abs(r.unique_count - e) <= max(2, 0.1 * e)


def test_scope_filter_long_pair_list(spark):
    df = spark.createDataFrame([("D1", "S1", 1), ("D1", "S2", 2), ("D2", "S1", 3)],
                               "database_name string, schema_name string, v int")
    pairs = ["D1.S1"] + [f"X{i}.Y" for i in range(55)]
    out = M.scope_filter(df, ["D1", "D2"], pairs)
    assert [r.v for r in out.collect()] == [1]
    assert [r.v for r in M.scope_filter(df, [], ["D1.S2", "D2.S1"]).orderBy("v").collect()] == [2, 3]


def test_null_in_accepted_list_changes_nothing(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "v string")
    dom = spark.createDataFrame([("a",), (None,)], "x string")
    for p in (("values", ("a", None)), ("values", ("a", None, *map(str, range(2000)))), ("domain", dom)):
        assert _vals(measure(df, [Check("ACCEPTED_VALUES", "V", (p,))], "t")) == {("v", "ACCEPTED_VALUES"): 2.0}


def test_unknown_distinct_metric_is_refused(spark):
    import pytest

    from tessera.functions import registry as R
    R.register_metric(R.Metric("MODE_SHARE", "column", ("ALL",), "distinct"))
    try:
        with pytest.raises(ValueError, match="MODE_SHARE"):
            measure(spark.createDataFrame([(1,)], "v int"), [Check("MODE_SHARE", "v")], "t")
    finally:
        R._REGISTRY.pop("MODE_SHARE")


def test_two_policies_for_one_monitor_give_one_row(spark):
    res = spark.createDataFrame([("m", 5.0)], "monitor_name string, metric_value double")
    th = spark.createDataFrame([("m", 0.0, 10.0), ("m", 1.0, 4.0)],
                               "monitor_name string, threshold_min double, threshold_max double")
    out = M.threshold_status(res, th).collect()
    assert [(r.threshold_min, r.threshold_max, r.status) for r in out] == [(1.0, 4.0, "FAIL")]


def test_sampled_null_cell_keeps_its_place(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert D.sample_rows(df, "t", "a").first().row_text == "1 | NULL | x"


def test_column_samples_stay_in_their_schema(spark):
    cols = spark.createDataFrame([("D", s, "T", "C", "INT", None) for s in ("S1", "S2")],
                                 "database_name string, schema_name string, table_name string, column_name string, "
                                 "data_type string, current_description string")
    vals = spark.createDataFrame([("D", "S1", "T", "C", 1, "first!"), ("D", "S2", "T", "C", 1, "second!")],
                                 "database_name string, schema_name string, table_name string, column_name string, "
                                 "sample_rank long, value_text string")
    got = {r.schema_name: r.prompt for r in D.column_prompts(cols, vals).collect()}
    assert "first!" in got["S1"] and "second!" not in got["S1"]
    assert "second!" in got["S2"] and "first!" not in got["S2"]


def test_export_name():
    from tessera.sinks.tables import export_name
    assert export_name("quality_monitors", dt.datetime(2024, 1, 2, 3, 4, 5)) == \
        "quality_monitors_20240102_030405.csv"


def test_batched_distinct_equals_per_column(spark, frame):
    checks = [Check(m, c) for c in ("id", "s", "x", "d")
              for m in ("UNIQUE_COUNT", "DUPLICATE_COUNT", "DUPLICATE_VALUES")]
    one = _vals(measure(frame, checks, "t", distinct_batch=1))
    for b in (2, 3, 4, 8):
        assert _vals(measure(frame, checks, "t", distinct_batch=b)) == one
    arr = spark.createDataFrame([([1, 2], "a"), ([1, 2], "a"), (None, None)], "a array<int>, s string")
    ac = [Check(m, c) for c in ("a", "s") for m in ("UNIQUE_COUNT", "DUPLICATE_COUNT")]
    assert _vals(measure(arr, ac, "t", distinct_batch=1)) == _vals(measure(arr, ac, "t", distinct_batch=2))
    empty = spark.createDataFrame([], "a long, b string")
    ec = [Check("UNIQUE_COUNT", "a"), Check("DUPLICATE_COUNT", "b")]
    assert _vals(measure(empty, ec, "t", distinct_batch=2)) == {("a", "UNIQUE_COUNT"): 0.0,
                                                                ("b", "DUPLICATE_COUNT"): 0.0}


def test_name_filters_are_case_insensitive(spark):
    from tessera.operators import catalog as C
    objs = spark.createDataFrame([("MyDb", "Sales", "t1", "BASE TABLE", None, "no")],
                                 "table_catalog string, table_schema string, table_name string, "
                                 "table_type string, comment string, is_secure string")
    assert C.objects_listing(objs, "MYDB", "sales").count() == 1
    assert C.schemas(objs, "mydb").count() == 1


def test_completer_sees_bounded_chunks(spark):
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(25)], "prompt string").coalesce(1)

    def completer(s: pd.Series) -> pd.Series:
        assert len(s) <= 10
        return "d:" + s

    rows = D.complete_with(prompts, completer, batch_size=10).collect()
    assert sorted(r.description for r in rows) == sorted(f"d:p{i}" for i in range(25))
    assert all(r.error is None for r in rows)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, None, 3.0)], ["a b", "x.y", "we`ird"])
    checks = [Check("ROW_COUNT")] + [Check(m, c) for c in ("a b", "x.y", "we`ird")
                                     for m in ("NULL_COUNT", "UNIQUE_COUNT", "DUPLICATE_COUNT")]
    checks += [Check("MAX", "we`ird"), Check("MIN", "a b")]
    for b in (1, 4):
        v = _vals(measure(df, checks, "t", distinct_batch=b))
        assert v[(None, "ROW_COUNT")] == 2
        assert v[("a b", "DUPLICATE_COUNT")] == 1 and v[("x.y", "NULL_COUNT")] == 1
        assert v[("we`ird", "MAX")] == 3.0 and v[("a b", "MIN")] == 1.0


def test_measure_checks_in_jobs_equals_one_union(spark, sf_dir):
    from tessera.operators import checks as CK
    from tessera.operators.metrics import measure_checks, measure_checks_in_jobs
    from tessera.sources.catalog import schemas_columns
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region", "supplier")}
    checks = CK.expand_checks(schemas_columns(frames, "", ""))
    resolver = lambda db, schema, table: frames[table]
    key = lambda t: tuple("" if x is None else str(x) for x in t)
    one = sorted((tuple(r) for r in measure_checks(spark, checks, resolver=resolver).collect()), key=key)
    parts = [tuple(r) for df in measure_checks_in_jobs(spark, checks, 1, resolver=resolver)
             for r in df.collect()]
    assert one == sorted(parts, key=key) and len(one) > 10


def test_distinct_counts_on_empty_frame(spark):
    from tessera.operators.scalars import distinct_counts
    df = spark.createDataFrame([], "a string, b string")
    row = distinct_counts(df, {"ua": "a", "ub": "b"}, total="n").collect()[0]
    assert (row.n, row.ua, row.ub) == (0, 0, 0)


def test_failures_have_reasons_and_counts(spark, sf_dir):
    from tessera.operators.metrics import outcome_counts
    from tessera.plans.metric_queries import failing_run
    res = failing_run(spark, sf_dir)
    assert tuple(outcome_counts(res).first()) == (5, 5)
    why = {(r["column_name"], r["metric_name"]): r["error"] for r in res.where("error IS NOT NULL").collect()}
    assert "DIVIDE_BY_ZERO" in why["o_totalprice", "PER_IMPOSSIBLE"]
    assert "no column" in why["no_such_column", "NEGATIVE_COUNT"]
    assert "unknown metric" in why["user_id", "NO_SUCH_METRIC"]


def test_replaced_metric_is_not_derived_from_groups(spark):
    from tessera.functions.registry import Metric, get_metric, register_metric
    from tessera.operators.metrics import Check, measure
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a",), ("",), (None,)], "s string")
    old = get_metric("NULL_COUNT")
    register_metric(Metric("NULL_COUNT", "column", ("ALL",), "scan",
                           lambda c, p: F.count_if(c.isNull() | (c == "")).cast("double")))
    try:
        got = {r["metric_name"]: r["value"] for r in
               measure(df, [Check("NULL_COUNT", "s"), Check("UNIQUE_COUNT", "s")], "t").collect()}
    finally:
        register_metric(old)
    assert got == {"NULL_COUNT": 2.0, "UNIQUE_COUNT": 2.0}


def test_accepted_values_from_groups_equal_the_scan(spark):
    from tessera.operators.metrics import Check, measure
    long = "x" * 80
    df = spark.createDataFrame([("a",), ("b",), (long,), (long + "y",), (None,), ("b",)], "s string")
    check = Check("ACCEPTED_VALUES", "s", (("values", ("a", None, long)),))
    alone = measure(df, [check], "t").first()["value"]
    both = measure(df, [check, Check("UNIQUE_COUNT", "s")], "t").where("metric_name = 'ACCEPTED_VALUES'").first()["value"]
    assert alone == both == 3.0


def test_samples_of_two_schemas_stay_apart(spark):
    from tessera.operators import describe as D
    from tessera.sources.catalog import schema_columns
    from tessera.operators.catalog import columns_listing
    a = spark.createDataFrame([(1, "left")], "k long, v string")
    b = spark.createDataFrame([(1, "right"), (1, "also"), (None, "none")], "k long, v string")
    samples = (D.column_samples(a, "t", "k", database="d", schema="s1")
               .unionByName(D.column_samples(b, "t", "k", database="d", schema="s2")))
    cols = columns_listing(schema_columns(a, "t", "d", "s1").unionByName(schema_columns(b, "t", "d", "s2")), sort=False)
    got = {(r["schema_name"], r["column_name"]): r["prompt"] for r in D.column_prompts(cols, samples).collect()}
    assert "left" in got["s1", "v"] and "right" not in got["s1", "v"]
    assert all(w in got["s2", "v"] for w in ("right", "also", "none")) and "left" not in got["s2", "v"]
    rows = D.sample_rows(b, "t", "k", 2).orderBy("rn").collect()
    assert [r["row_text"] for r in rows] == ["NULL | none", "1 | also"]


def test_documentation_is_written_once_and_retried_runs_replace(spark, sf_dir, tmp_path):
    import pandas as pd
    from tessera.operators.documentation import document_schema
    calls = str(tmp_path / "calls")

    def counting(prompts: pd.Series) -> pd.Series:
        with open(calls, "a") as f:
            f.write("x" * len(prompts))
        return pd.Series(["text %d" % i for i in range(len(prompts))])

    spark.sql("CREATE DATABASE doc_once")
    try:
        spark.sql("CREATE TABLE doc_once.`Ab` (x INT, y STRING) USING parquet")
        place = str(tmp_path / "log")
        for _ in range(2):
            run = document_schema(spark, "doc_once", tables=["AB"], completer=counting, updated_by="u",
                                  updated_at="2024-01-01 00:00:00", location=place, run_id="r1")
        assert run.report.succeeded == 3 and not run.report.failed
        said = {r["column_name"]: r["description"] for r in run.suggestions.collect()}
        log = {r["column_name"]: r["after_description"] for r in spark.read.parquet(run.log_path).collect()}
        assert log == said and len(open(calls).read()) == 6
        kept = {c.name: c.description for c in spark.catalog.listColumns("doc_once.ab")}
        assert kept == {c: said[c] for c in ("x", "y")}
        for bad in (dict(schema=""), dict(schema="doc_once", tables=[]), dict(schema="doc_once", generation_type="ALL")):
            with __import__("pytest").raises(ValueError):
                document_schema(spark, **bad)
    finally:
        spark.sql("DROP DATABASE doc_once CASCADE")


def test_schedule_resumes(spark, sf_dir, tmp_path):
    from tessera.plans.stream_queries import arrivals
    res = arrivals(spark, sf_dir, str(tmp_path / "arrivals"))
    counts = [r["value"] for r in res.where("metric_name = 'ROW_COUNT'").orderBy("batch_id").collect()]
    total = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert len(counts) == 6 and counts == sorted(counts) and counts[-1] == total

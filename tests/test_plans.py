"""Plan-shape guards for the scale properties the engine relies on (read from explain())."""

import contextlib
import io

import __spark_entry__ as E

Q = E.queries()


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_suite_has_no_expand_and_prunes_columns(spark, sf_dir):
    p = _plan(Q["metric_suite"](spark, sf_dir))
    assert "Expand" not in p
    # a distinct batch reads only its own four columns ...
    assert ("ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,"
            "l_linenumber:int>") in p
    # ... and NULL / ROW counts come from those batches: every lineitem read is a batch
    # (at most 4 columns) -- no extra scan of all columns for the scan metrics
    import re
    for schema in re.findall(r"ReadSchema: struct<(l_[^>]*)>", p):
        assert schema.count(":") <= 4, schema
    # FRESHNESS of l_shipdate comes from its value groups: no stand-alone scan of it
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" not in p


def test_threshold_policy_is_broadcast(spark, sf_dir):
    p = _plan(Q["monitor_summary"](spark, sf_dir))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_time_range_filter_reaches_the_scan(spark, sf_dir):
    p = _plan(Q["results_last_7d"](spark, sf_dir))
    assert "ts#" in p and ">= 2024-01-24 00:00:00" in p and "DataFilters" in p


def test_listings_feeding_joins_are_not_sorted(spark, sf_dir):
    for name in ("contacts_pivot", "unmonitored_objects", "generate_descriptions", "kpi_overview"):
        p = _plan(Q[name](spark, sf_dir))
        assert "rangepartitioning" not in p, name


def test_listings_and_samples_are_top_k(spark, sf_dir):
    for name in ("quality_results", "history_descriptions", "recent_failures", "sample_table_rows",
                 "sample_column_values"):
        p = _plan(Q[name](spark, sf_dir))
        assert "TakeOrderedAndProject" in p, name


def test_semi_and_anti_joins_use_distinct_keys(spark, sf_dir):
    p = _plan(Q["unmonitored_objects"](spark, sf_dir))
    assert "LeftAnti" in p and "HashAggregate" in p


def test_history_counters_avoid_expand(spark, sf_dir):
    assert "Expand" not in _plan(Q["history_summary"](spark, sf_dir))


def test_suite_runs_the_joined_source_once(spark, sf_dir):
    p = _plan(Q["metric_suite"](spark, sf_dir))
    assert p.count("documents.parquet") == 1 and p.count("labels.parquet") == 1


def test_overview_reads_each_source_once(spark, sf_dir):
    assert _plan(Q["kpi_overview"](spark, sf_dir)).count("FileScan parquet") == 4
    assert _plan(Q["history_summary"](spark, sf_dir)).count("FileScan parquet") == 1

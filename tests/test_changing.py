"""Tables that change: signed value groups, their store, the file ledger, metrics while writing."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import groups as GR
from tessera.operators import metrics as MT
from tessera.operators.groups import MERGED, add_up, merged_metrics, value_groups
from tessera.operators.ledger import FileLedger
from tessera.operators.metrics import Check, column_checks, measure, measure_checks_to
from tessera.operators.observed import write_measured
from tessera.streaming import changes as CH


def _results(df, column="value"):
    return {(r["column_name"], r["metric_name"]): r[column] for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, nan, zeros of both signs, long texts, binaries, nested values, large integers."""
    rows = [(i % 7 if i % 5 else None, [0.0, -0.0, float("nan"), 1.5, None][i % 5], ["a", "", "é" * 70, None][i % 4],
             bytes([i % 3]) * (40 * (i % 2)), dt.datetime(2024, 1, 1 + i % 9, 3, 4, 5, i), [i % 3, None] if i % 4 else None,
             {"k": i % 2, "l": None}, 9007199254740993 - i % 2, bool(i % 2)) for i in range(60)]
    return spark.createDataFrame(rows, "i int, x double, s string, b binary, ts timestamp, a array<int>, m map<string,int>, "
                                       "big long, f boolean")


def test_groups_give_what_measure_gives(odd):
    checks = [Check("ROW_COUNT"), *column_checks(odd, [m for m in MERGED if m not in ("ROW_COUNT", "ACCEPTED_VALUES")]),
              Check("ACCEPTED_VALUES", "s", (("values", ("a", "é" * 70)),))]
    types = {f.name: f.dataType for f in odd.schema.fields}
    as_of = "2024-02-01 00:00:00"
    groups = value_groups(odd, odd.columns)
    got, want = merged_metrics(groups, checks, types, "t", as_of, texts=True), measure(odd, checks, "t", as_of=as_of, texts=True)
    assert {k: str(v) for k, v in _results(got, "value_text").items()} == {k: str(v) for k, v in _results(want, "value_text").items()}
    assert {k: str(v) for k, v in _results(got).items()} == pytest.approx({k: str(v) for k, v in _results(want).items()})
    # taking all rows away again leaves an empty table
    gone = groups.unionByName(value_groups(odd, odd.columns, F.lit(-1)))
    assert add_up(gone).count() == 0
    none, empty = _results(merged_metrics(gone, checks, types, "t", as_of)), _results(measure(odd.limit(0), checks, "t", as_of=as_of))
    assert none == empty


def test_extremes_are_exact_as_text(odd):
    got = _results(measure(odd, [Check("MAX", "big"), Check("MIN", "big"), Check("MAX", "i"), Check("UNIQUE_COUNT", "i"),
                                 Check("AVG", "i"), Check("NO_SUCH", "i")], "t", texts=True), "value_text")
    assert got == {("big", "MAX"): "9007199254740993", ("big", "MIN"): "9007199254740992", ("i", "MAX"): "6",
                   ("i", "UNIQUE_COUNT"): "7", ("i", "AVG"): None, ("i", "NO_SUCH"): None}


def test_nested_values_travel_as_digests(spark, odd):
    df = odd.withColumn("v", F.expr("parse_json(concat('{\"b\":', i, ',\"a\":[1]}'))")).withColumn(
        "st", F.struct("x", F.map_from_entries(F.array(F.struct(F.lit(1), "x"))).alias("y")))
    got = _results(measure(df, column_checks(df, ["UNIQUE_COUNT", "NULL_COUNT"], ["a", "m", "v", "st"]), "t"))
    assert got == {("a", "UNIQUE_COUNT"): 3, ("a", "NULL_COUNT"): 15, ("m", "UNIQUE_COUNT"): 2, ("m", "NULL_COUNT"): 0,
                   ("v", "UNIQUE_COUNT"): 7, ("v", "NULL_COUNT"): 12, ("st", "UNIQUE_COUNT"): 4, ("st", "NULL_COUNT"): 0}
    plan = measure(df, [Check("UNIQUE_COUNT", "a"), Check("UNIQUE_COUNT", "v")], "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" in plan and "Aggregate [cid" in plan


def _feed(spark, changes):
    return spark.createDataFrame(changes, "k int, v string, kind string")


def test_fifty_arrivals_of_a_feed(spark, tmp_path):
    """After every arrival the results are those of the table as it then stands, and an arrival
    reads a snapshot and a bounded number of deltas."""
    rnd, table, states, place = random.Random(2), {}, [], str(tmp_path / "feed")
    for n in range(50):
        out = []
        for _ in range(rnd.randint(1, 6)):
            k = rnd.randint(0, 12)
            if k in table:
                out.append((k, table[k], rnd.choice(("delete", "update_preimage"))))
                del table[k]
                if out[-1][2] == "delete":
                    continue
            table[k] = rnd.choice(("a", "b", "c", None))
            out.append((k, table[k], "update_postimage" if out and out[-1][2] == "update_preimage" else "insert"))
        _feed(spark, out).coalesce(1).write.mode("append").parquet(place)
        os.utime(next(p for p in (tmp_path / "feed").glob("*.parquet") if p not in {s[0] for s in states}), (n + 1, n + 1))
        states.append((next(p for p in (tmp_path / "feed").glob("*.parquet") if p not in {s[0] for s in states}),
                       len(table), len({v for v in table.values() if v}), sum(v is None for v in table.values()),
                       max(table, default=None)))
    stream = spark.readStream.schema("k int, v string, kind string").option("maxFilesPerTrigger", 1).parquet(place)
    seen, real = [], CH.GroupStore._read
    CH.GroupStore._read = lambda self, paths: (seen.append(len(paths)), real(self, paths))[1]
    try:
        res = CH.on_change(stream, [Check("ROW_COUNT"), Check("UNIQUE_COUNT", "v"), Check("NULL_COUNT", "v"), Check("MAX", "k")], "t",
                           location=str(tmp_path / "run"), change_kind="kind", compact_every=6)
    finally:
        CH.GroupStore._read = real
    by = {}
    for r in res.collect():
        by.setdefault(r["batch_id"], {})[r["metric_name"]] = r["value"]
    assert [(by[n]["ROW_COUNT"], by[n]["UNIQUE_COUNT"], by[n]["NULL_COUNT"], by[n]["MAX"]) for n in range(50)] == [s[1:] for s in states]
    assert max(seen) <= 7
    assert len(list((tmp_path / "run/groups/snapshots").glob("upto=*"))) == 2
    assert len(list((tmp_path / "run/groups/deltas").glob("batch_id=*"))) <= 12


def test_an_arrival_processed_again_counts_once(spark, tmp_path):
    store = CH.GroupStore(spark, str(tmp_path), compact_every=2)
    one = spark.createDataFrame([("c", "v", 1)], "column_name string, v string, n long")
    for batch in range(7):
        for _ in range(2):
            assert store.add(batch, one).agg(F.sum("n")).first()[0] == batch + 1
    with pytest.raises(Exception, match="unknown kind"):
        _feed(spark, [(1, "a", "upsert")]).select(CH.change_weight("kind")).collect()


def test_deletes_that_come_first(spark):
    late = _feed(spark, [(1, "a", "delete"), (2, "b", "insert")])
    types = {f.name: f.dataType for f in late.schema.fields}
    checks = [Check("ROW_COUNT"), Check("UNIQUE_COUNT", "v")]
    first = value_groups(late, ["v"], CH.change_weight("kind"))
    assert set(_results(merged_metrics(first, checks, types, "t")).values()) == {1.0}
    both = first.unionByName(value_groups(_feed(spark, [(1, "a", "insert")]), ["v"], CH.change_weight("kind")))
    assert set(_results(merged_metrics(both, checks, types, "t")).values()) == {1.0}


def test_ledger_reads_new_files_only(spark, sf_dir, tmp_path):
    from tessera.plans.stream_queries import _LEDGER_CHECKS, ledger_runs
    ledger, table, results = ledger_runs(spark, sf_dir, str(tmp_path))
    by_run = {r["run"]: r["count"] for r in ledger.files().groupBy("run").count().collect()}
    assert sorted(by_run.values()) == [1, 3]
    want = _results(measure(spark.read.parquet(table), _LEDGER_CHECKS, "events", as_of="2024-01-31 00:00:00"))
    assert _results(results) == pytest.approx(want)
    again = ledger.refresh(table, as_of="2024-01-31 00:00:00")
    assert _results(again) == pytest.approx(want) and ledger.files().select("run").distinct().count() == 2
    assert ledger.vacuum(table) == 0
    files = sorted(os.listdir(table))
    for f in [f for f in files if f.endswith(".parquet")]:
        os.remove(f"{table}/{f}")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    assert _results(ledger.refresh(table, schema))[(None, "ROW_COUNT")] == 0
    assert ledger.vacuum(table) == 2 and ledger.files().count() == 0
    with pytest.raises(ValueError, match="STDDEV"):
        FileLedger(spark, str(tmp_path / "l2"), [Check("STDDEV", "value")], "events").refresh(table, schema)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows_of_files(place):
    """Rows of every Parquet file under a folder."""
    import pyarrow.parquet as pq
    return [pq.ParquetFile(p).metadata.num_rows for p in sorted(place.rglob("*.parquet"))]


def test_a_file_is_grouped_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """One file with one row group: no task groups all of it, none adds up all groups."""
    monkeypatch.setattr(GR, "ENTRIES_A_TASK", 1000)
    df = spark.range(4000).selectExpr("id", "id % 7 AS few", "cast(NULL AS string) AS none", "concat('f', id) AS file",
                                      "if(id % 2 = 0, id, NULL) AS `__c0`")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    checks = [Check("ROW_COUNT"), *column_checks(df, ["NULL_COUNT", "UNIQUE_COUNT", "DUPLICATE_VALUES", "MIN", "MAX"])]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    got = FileLedger(spark, str(tmp_path / "l"), checks, "t").refresh(str(tmp_path / "t"))
    assert {k: spark.conf.get(k) for k in before} == before
    assert _results(got) == _results(measure(spark.read.parquet(str(tmp_path / "t")), checks, "t"))
    stored = _rows_of_files(tmp_path / "l/groups")
    assert sum(stored) == 4000 + 7 + 1 + 4000 + 2001 and max(stored) < 1000
    assert "hashpartitioning(column_name" in _plan(got) and "REPARTITION_BY_NUM" in _plan(got)
    dealt = value_groups(spark.read.parquet(str(tmp_path / "t")), ["id"], tasks=20)
    assert "RoundRobinPartitioning(20)" in _plan(dealt)
    assert sorted(dealt.collect()) == sorted(value_groups(df, ["id"]).collect())


def test_an_arrival_is_grouped_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """One large file of a feed: its delta, and the snapshot, are added up by several tasks."""
    monkeypatch.setattr(GR, "ENTRIES_A_TASK", 1000)
    place, kind = str(tmp_path / "feed"), "k int, v string, kind string"
    for lot, change in ((4000, "insert"), (1500, "delete"), (500, "insert")):
        spark.range(lot).selectExpr("cast(id AS int) AS k", "if(id % 3 = 0, NULL, concat('v', id)) AS v",
                                    f"'{change}' AS kind").coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(place)
        res = CH.on_change(stream, [Check("ROW_COUNT"), Check("UNIQUE_COUNT", "k"), Check("NULL_COUNT", "v"), Check("MIN", "k")], "t",
                           location=str(tmp_path / "run"), change_kind="kind", compact_every=2)
    last = {r["metric_name"]: r["value"] for r in res.collect() if r["batch_id"] == 2}
    assert last == {"ROW_COUNT": 3000, "UNIQUE_COUNT": 3000, "NULL_COUNT": 1001, "MIN": 0}
    delta = _rows_of_files(tmp_path / "run/groups/deltas/batch_id=0")
    assert sum(delta) == 4000 + 2666 + 1 and max(delta) < 1000
    snapshot = _rows_of_files(tmp_path / "run/groups/snapshots/upto=2")
    assert sum(snapshot) == 3000 + 1999 + 1 and max(snapshot) < 1000


def test_a_large_lot_of_the_feed_comes_in_several_files(spark, sf_dir, tmp_path, monkeypatch):
    """Two arrivals a lot, however many files it has; results as of the table's last state."""
    from tessera.plans import stream_queries as SQ
    monkeypatch.setattr(SQ, "ROWS_A_FILE", 100)
    res = SQ.feed_results(spark, sf_dir, str(tmp_path))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 7 <> 0")
    last = res.where("batch_id = 5 AND metric_name = 'ROW_COUNT'").first()["value"]
    assert res.agg(F.max("batch_id")).first()[0] == 5 and last == orders.count()
    assert len(_rows_of_files(tmp_path / "feed")) > 12


def test_dealing_holds_no_split(spark, tmp_path):
    """No task sorts or holds what it read, in one step up to 200 tasks or in two beyond."""
    df = spark.range(0, 50_000, 1, 3).selectExpr("id", "id % 7 AS few", "if(id % 5 = 0, NULL, concat('v', id)) AS v")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    want = sorted(map(tuple, value_groups(df, df.columns).collect()), key=str)
    steps = {20: ["RoundRobinPartitioning(20)"], 300: ["RoundRobinPartitioning(200)", "hashpartitioning(__i"]}
    for tasks, dealt in steps.items():
        rows = GR._dealt(table, tasks)
        assert [p for p in ("RoundRobinPartitioning(20)", "RoundRobinPartitioning(200)", "hashpartitioning(__i") if p in _plan(rows)] == dealt
        assert rows.columns == table.columns and rows.rdd.getNumPartitions() == tasks
        with GR._shuffled_into(spark, tasks):
            assert spark.conf.get("spark.sql.execution.sortBeforeRepartition") == "false"
            sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == tasks and sum(sizes) == 50_000 and max(sizes) < 1.5 * 50_000 / tasks
        GR.write_groups(value_groups(table, table.columns, tasks=tasks), str(tmp_path / f"g{tasks}"), tasks)
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / f"g{tasks}")).collect()), key=str) == want
    assert spark.conf.get("spark.sql.execution.sortBeforeRepartition") == "true"


def test_lots_of_the_ledger_are_dealt_by_id(spark, sf_dir):
    """All events come in one lot each, and no lot is sorted to be dealt."""
    from tessera.plans import stream_queries as SQ
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lots = [SQ.event_lot(events, lot, 3) for lot in range(4)]
    assert "hashpartitioning(event_id" in _plan(lots[0]) and "RoundRobin" not in _plan(lots[0])
    got = lots[0].unionByName(lots[1]).unionByName(lots[2]).unionByName(lots[3])
    assert got.exceptAll(events).count() == 0 and events.where("event_id IS NOT NULL").exceptAll(got).count() == 0


def test_metrics_while_writing(spark, sf_dir, odd, tmp_path):
    checks = [Check("ROW_COUNT"), *column_checks(odd, ["NULL_COUNT", "MIN", "MAX", "AVG", "FRESHNESS", "UNIQUE_COUNT"]),
              Check("AVG", "s"), Check("NEGATIVE_COUNT", "nope")]
    as_of = "2024-02-01 00:00:00"
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b
    source = odd.mapInArrow(counted, odd.schema)
    got = write_measured(source, str(tmp_path / "t"), checks, "t", as_of=as_of, texts=True, reasons=True)
    assert {k: str(v) for k, v in _results(got).items()} == {k: str(v) for k, v in _results(measure(odd, checks, "t", as_of=as_of)).items()}
    assert runs.value == 60                                       # the source ran once
    assert got.where("error IS NOT NULL").count() == 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 60
    with pytest.raises(ValueError, match="append"):
        write_measured(odd, str(tmp_path / "t"), checks, "t", mode="append")
    empty = write_measured(odd.limit(0), str(tmp_path / "e"), [Check("ROW_COUNT"), Check("MAX", "i")], "t")
    assert _results(empty) == {(None, "ROW_COUNT"): 0.0, ("i", "MAX"): None}


def test_a_failing_check_is_found_by_halves(spark, tmp_path, monkeypatch):
    from tessera.functions.registry import sql_metric
    sql_metric("TEST_DIVIDES", "sum({col}) / count_if({col} IS NULL AND {col} IS NOT NULL)")
    df = spark.range(50).selectExpr(*[f"id AS c{i}" for i in range(64)])
    rows = [("", "", "t", "TEST_DIVIDES" if i == 37 else "MAX", f"c{i}") for i in range(64)]
    checks = spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, metric_name string, "
                                         "column_name string")
    jobs, real = [], MT._measure_tables
    monkeypatch.setattr(MT, "_measure_tables", lambda *a, **k: (jobs.append(1), real(*a, **k))[1])
    out = measure_checks_to(spark, checks, str(tmp_path / "r"), resolver=lambda d, s, t: df)
    bad = out.where("error IS NOT NULL").collect()
    assert [r["column_name"] for r in bad] == ["c37"] and out.where("value = 49").count() == 63
    assert len(jobs) <= 2 * 6 + 1


def test_a_column_without_groups_fails_alone(spark):
    df = spark.sql("SELECT 1 AS a, make_interval(1) AS i")
    got = measure(df, column_checks(df, ["UNIQUE_COUNT", "NULL_COUNT"]), "t", reasons=True).collect()
    by = {(r["column_name"], r["metric_name"]): r for r in got}
    assert by["a", "UNIQUE_COUNT"]["value"] == 1 and by["a", "UNIQUE_COUNT"]["error"] is None
    assert len(by) == 4

"""Measurement on change (W3): after each arrival a result set about the whole table.

An arrival adds its value groups (``operators.groups``) to the stored ones, so old rows are
never read again. The store is a snapshot and the deltas since: when enough deltas have
gathered, they and the snapshot become the next snapshot. Arrivals may be plain rows, or a
change feed with updates and deletes, whose groups count negatively.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.groups import GROUP_SCHEMA, add_up, from_groups, merged_metrics, tasks_for, value_groups, write_groups
from tessera.operators.metrics import measure, validate_checks
from tessera.session import file_system, scratch_path, unique_name

#: Deltas that an arrival reads at most, besides the snapshot.
COMPACT_EVERY = 8

# How change feeds name their rows.
ADDED, REMOVED = ("insert", "update_postimage"), ("delete", "update_preimage")


def change_weight(kind: str) -> Column:
    """1 for a row that came, -1 for one that went; any other kind is an error."""
    k = F.col(kind)
    return F.when(k.isin(*ADDED), 1).when(k.isin(*REMOVED), -1).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(k.cast("string"), F.lit("NULL")))))


class GroupStore:
    """The stored groups of a table under ``location``: ``deltas/batch_id=<n>`` for an arrival,
    ``snapshots/upto=<n>`` for all arrivals up to one.

    An arrival that is processed again (after a failure) replaces its own delta, and reads
    only snapshots from before it, so nothing counts twice."""

    def __init__(self, spark: SparkSession, location: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.location, self.compact_every = spark, location, compact_every

    def _numbers(self, kind: str) -> dict[int, str]:
        files, place = file_system(self.spark, f"{self.location}/{kind}")
        if not files.exists(place):
            return {}
        paths = [str(s.getPath().toString()) for s in files.listStatus(place)]
        return {int(p.rpartition("=")[2]): p for p in paths if "=" in p.rpartition("/")[2]}

    def runs(self, batch_id: int) -> list[str]:
        """The newest snapshot before an arrival, and the deltas since, its own included."""
        snapshots = {n: p for n, p in self._numbers("snapshots").items() if n < batch_id}
        upto = max(snapshots, default=-1)
        deltas = {n: p for n, p in self._numbers("deltas").items() if upto < n <= batch_id}
        return ([snapshots[upto]] if snapshots else []) + [deltas[n] for n in sorted(deltas)]

    def add(self, batch_id: int, groups: DataFrame, tasks: int = 1) -> DataFrame:
        """Store the groups of an arrival, added up in ``tasks`` tasks; returns those of the
        whole table so far."""
        write_groups(groups, f"{self.location}/deltas/batch_id={batch_id}", tasks, "overwrite")
        runs = self.runs(batch_id)
        if len(runs) <= self.compact_every:
            return self._read(runs)
        place = f"{self.location}/snapshots/upto={batch_id}"
        gathered = self._read(runs)
        add_up(gathered, tasks_for(gathered.count())).write.mode("overwrite").parquet(place)
        self._prune(batch_id)
        return self._read([place])

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(GROUP_SCHEMA).parquet(*paths)

    def _prune(self, batch_id: int) -> None:
        """Delete what the snapshot before the newest one holds: should this arrival be
        processed again, that one and the deltas since are still there."""
        upto = max((n for n in self._numbers("snapshots") if n < batch_id), default=-1)
        old = [p for kind in ("deltas", "snapshots") for n, p in self._numbers(kind).items()
               if n < upto or n == upto and kind == "deltas"]
        for path in old:
            files, place = file_system(self.spark, path)
            files.delete(place, True)


def on_change(stream: DataFrame, checks, table_name: str, name: str = "on_change", as_of=None,
              location: str | None = None, table=None, change_kind: str | None = None,
              compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Measure the table whenever data arrives: one result set per arrival (``batch_id``),
    each about the whole table so far.

    ``change_kind`` names the column of a change feed that tells what happened to a row:
    ``insert``, ``delete``, or ``update_preimage`` and ``update_postimage`` for its state
    before and after. Without it every row is an insert. Metrics that value groups give
    (``groups.MERGED``) never read old data again; others are measured on ``table()``, the
    table behind the stream.

    ``location`` is a shared folder with results, groups and checkpoint; a call with it
    resumes and processes only what is new. Every arrival has its own partition, written with
    overwrite, so one replayed after a failure replaces its output.
    """
    spark = stream.sparkSession
    out = location or scratch_path(spark, "streams", unique_name(name))
    ok, failed = validate_checks(stream.drop(change_kind) if change_kind else stream, checks)
    types = {f.name: f.dataType for f in stream.schema.fields}
    merged = [c for c in ok if from_groups(c, types.get(c.column))]
    other = [c for c in ok if c not in merged] + [c for c, _ in failed]
    if other and table is None:
        raise ValueError("these metrics need the table behind the stream: "
                         + ", ".join(sorted({c.metric for c in other})))
    columns = sorted({c.column for c in merged if c.column})
    store = GroupStore(spark, f"{out}/groups", compact_every)

    def each(batch: DataFrame, batch_id: int) -> None:
        parts = []
        if merged:
            weight = change_weight(change_kind) if change_kind else None
            tasks = tasks_for(batch.count() * max(1, len(columns)))
            whole = store.add(batch_id, value_groups(batch, columns, weight, tasks=tasks), tasks)
            parts.append(merged_metrics(whole, merged, types, table_name, as_of, tasks=tasks_for(whole.count())))
        if other:
            parts.append(measure(table(), other, table_name, as_of=as_of))
        reduce(lambda a, b: a.unionByName(b), parts).write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", out + "/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out + "/data")

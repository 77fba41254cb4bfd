"""Re-measuring a table by its files (W1, W6): partial states are kept per input file.

A refresh lists the table's files, reads only those the ledger has not met, and adds up the
stored value groups of the files that are there now. A removed file takes its rows with it, a
rewritten one (other size or time) is a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.groups import GROUP_SCHEMA, from_groups, merged_metrics, tasks_for, value_groups, write_groups
from tessera.operators.metrics import validate_checks
from tessera.session import file_system, unique_name

FILE_SCHEMA = "file string, run string"


def _file_key() -> Column:
    """Path, size and time of the file a row comes from."""
    m = "_metadata."
    return F.concat_ws("|", F.col(m + "file_path"), F.col(m + "file_size").cast("string"),
                       F.unix_micros(m + "file_modification_time").cast("string"))


class FileLedger:
    """The ledger of one table at ``location``, a shared folder: ``files/run=<id>`` lists the
    files a refresh has read, ``groups/run=<id>`` holds their value groups. A run counts once
    its list is written, so a refresh that fails leaves nothing that counts."""

    def __init__(self, spark: SparkSession, location: str, checks, table_name: str, suffix: str = ".parquet"):
        self.spark, self.location = spark, location
        self.checks, self.table_name, self.suffix = list(checks), table_name, suffix

    def _stored(self, kind: str, schema: str) -> DataFrame:
        files, place = file_system(self.spark, f"{self.location}/{kind}")
        if not files.exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.location}/{kind}")

    def files(self) -> DataFrame:
        """``file, run`` of all files read so far."""
        return self._stored("files", FILE_SCHEMA)

    def _listed(self, path: str) -> DataFrame:
        """``file, file_path`` of the table's files now: names and status, no content."""
        return self.spark.read.format("binaryFile").option("pathGlobFilter", f"*{self.suffix}").load(path).select(
            _file_key().alias("file"), F.col("_metadata.file_path").alias("file_path"))

    def refresh(self, path: str, schema=None, as_of=None, texts: bool = False) -> DataFrame:
        """Results of the Parquet table at ``path`` as its files are now, one row per check.

        Only checks that value groups give are taken (``groups.MERGED``); others raise. An
        empty folder gives the results of an empty table, and needs a ``schema``."""
        now = self._listed(path)
        known = self.files()
        new = now.join(known, "file", "left_anti")
        # names of new files: as many strings as the reader's own listing holds
        fresh = [r["file_path"] for r in new.select("file_path").collect()]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        if not fresh:
            table = reader.parquet(path) if now.limit(1).count() else self.spark.createDataFrame([], schema)
        elif known.limit(1).count():
            table = reader.option("basePath", path).parquet(*fresh)
        else:
            table = reader.parquet(path)
        ok, failed = validate_checks(table, self.checks)
        types = {f.name: f.dataType for f in table.schema.fields}
        wrong = [c.metric for c in ok if not from_groups(c, types.get(c.column))] + [f"{c.metric}: {why}" for c, why in failed]
        if wrong:
            raise ValueError("no value groups give " + ", ".join(wrong))
        if fresh:
            self._add(table, sorted({c.column for c in ok if c.column}), new)
        live = self.files().join(now.select("file"), "file", "left_semi")
        stored = self._stored("groups", f"file string, run string, {GROUP_SCHEMA}")
        groups = stored.join(live, ["file", "run"], "left_semi")
        return merged_metrics(groups, ok, types, self.table_name, as_of, texts, tasks_for(stored.count()))

    def _add(self, table: DataFrame, columns: list[str], new: DataFrame) -> None:
        run = unique_name("run")
        tasks = tasks_for(table.count() * max(1, len(columns)))
        keyed = table.select("*", _file_key().alias("__file"))
        groups = value_groups(keyed, columns, by=("__file",), tasks=tasks).withColumnRenamed("__file", "file")
        write_groups(groups, f"{self.location}/groups/run={run}", tasks)
        new.select("file").write.parquet(f"{self.location}/files/run={run}")

    def vacuum(self, path: str) -> int:
        """Delete the runs of which no file is left in the table; returns how many."""
        runs = self.files()
        kept = runs.join(self._listed(path), "file", "left_semi").select("run").distinct()
        gone = [r["run"] for r in runs.select("run").distinct().join(kept, "run", "left_anti").collect()]
        for run in gone:
            for kind in ("files", "groups"):
                files, place = file_system(self.spark, f"{self.location}/{kind}/run={run}")
                files.delete(place, True)
        return len(gone)

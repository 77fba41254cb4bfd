"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine depends on for correct results (UTC clocks) and for a sane plan
# at any scale (AQE re-plans shuffles, coalesces small partitions, splits skewed ones).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's base settings.

    On a cluster pass ``master=None`` and let the launcher decide; shuffle partitions
    should then be sized to the data (AQE coalesces from there).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # session-level settings also apply when the session already existed
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, stream checkpoints and written intermediates.

    Read from ``spark.checkpoint.dir`` (a cluster names a shared folder there). Only on a
    ``local`` master, where driver and executors are one machine, an unset value falls back
    to a private temporary folder; anywhere else an unset value is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset on master {master}: "
                             "name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint root."""
    return "/".join([checkpoint_root(spark), "tessera", *parts])


def file_system(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as that system's object."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def unique_name(prefix: str) -> str:
    """A folder name no other run, driver or process has used."""
    return f"{prefix}_{uuid.uuid4().hex}"


def size_shuffle_partitions(spark: SparkSession, total_input_bytes: int,
                            target_bytes: int = 256 << 20, minimum: int | None = None) -> int:
    """Set ``spark.sql.shuffle.partitions`` so a full shuffle of the input lands near
    ``target_bytes`` per partition (AQE coalesces smaller ones and splits skewed ones, but
    it can only merge partitions, never create more). Returns the value set."""
    minimum = minimum or spark.sparkContext.defaultParallelism
    n = max(minimum, -(-total_input_bytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(min(target_bytes, 128 << 20)))
    return n

"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_of, text_steps
from tessera.session import scratch_path, unique_name

# The kinds in the order of their spans, their patterns, and the least length
# of a match (of group 2 for assign).
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]

LEDGER = "blob string, rule_version string, findings array<struct<kind:string,s:int,e:int>>"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then in the order of the rules."""
    out = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        if kind == "assign":
            matches = _compiled(pattern, re.ASCII | re.IGNORECASE).finditer(text)
        else:
            # a run is matched whole from its first possible start, so too short runs can be
            # left out by the pattern itself
            tail = least - (4 if kind == "access" else 0)
            matches = _compiled(pattern[:-1] + "{%d,}" % tail, re.ASCII).finditer(text)
        out += [(m.start(), order, kind, m.end()) for m in matches if m.end(group) - m.start(group) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def _compiled(pattern: str, flags: int) -> re.Pattern:
    return re.compile(pattern, flags)  # the re module keeps compiled patterns


class BlobLedger:
    """What has been scanned: one row per (blob, rule version), with its findings.

    A folder of Parquet files in shared storage. Scans add rows and never rewrite any, so an
    interrupted scan leaves whole batches or nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "llm", unique_name("blob_ledger"))

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def scan(self, versions: DataFrame) -> DataFrame:
        """Scan the unseen blobs of ``versions`` (``blob, row_id, text``) and add them."""
        done = self.rows().where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        fresh = versions.groupBy("blob").agg(F.min("row_id").alias("row_id")).join(done, "blob", "left_anti")
        # one text per unseen blob: the other versions of it stay where they are
        texts = versions.join(fresh, ["blob", "row_id"], "left_semi").select("blob", "text")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
            for part in text_steps(batches):
                found = [[{"kind": k, "s": s, "e": e} for k, s, e in find_secrets(t)]
                         for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("blob"), pa.array([RULE_VERSION] * part.num_rows, pa.string()),
                     pa.array(found, kind)], names=["blob", "rule_version", "findings"])

        texts.mapInArrow(work, LEDGER).write.mode("append").parquet(self.path)
        return self.rows().where(F.col("rule_version") == RULE_VERSION)


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """``doc_id, blob, findings`` for every row of ``docs``: every text is a version of the
    path ``doc_id``, addressed by the SHA-256 of its content.

    Only pairs of blob and rule version that the ledger lacks are scanned, each once however
    many paths have it; findings then go back to all paths of the blob. Null counts as the
    empty text, without findings. Repeated rows (same id and text) each get the findings;
    where they stand for their blob they are scanned and entered side by side. Other columns are
    ignored; no rows in, no rows out.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    rows = docs.select("doc_id", text_of("text").alias("text")).withColumn("blob", F.sha2("text", 256))
    versions = rows.select("blob", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row_id"), "text")
    known = ledger.scan(versions).groupBy("blob").agg(F.first("findings").alias("findings"))
    return rows.select("doc_id", "blob").join(known, "blob", "left").select(
        "doc_id", "blob", F.coalesce("findings", F.array()).alias("findings"))


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the joined spans, and their digest."""
    spans = F.concat_ws(",", F.transform("findings", lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))

    def of_kind(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[of_kind(kind) for kind, *_ in RULES], F.sha2(spans, 256).alias("base_sha256"),
                        spans.alias("spans"))

"""Web archives in ZIP packages: written per task, read back record by record in place."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import zip_ranges
from tessera.llm.common import materialize, small, text_of, text_steps
from tessera.session import scratch_path, unique_name

#: Equal payloads of at least so many bytes are stored once in the registered query.
REVISIT_BYTES = 1000
#: A task begins its next package at so many bytes or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 64 << 20, 100_000
#: Records whose bytes lie within one such stretch of a package go to one task.
STRETCH = 16 << 20
#: One range read takes neighbouring records up to so many bytes, over gaps up to so many.
SPAN_BYTES, SPAN_GAP = 8 << 20, 64 << 10
#: Record bytes that a reading task gets, about (as long as every core has a task).
TASK_BYTES = 256 << 20

# Fixed values of the formats: member names, index suffix, versions, profile of revisits.
ARCHIVE_MEMBER, INDEX_MEMBER, ARCHIVES, INDEX_SUFFIX = "archive/data.warc.gz", "indexes/index.cdxj", "archive/", ".cdxj"
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Field of a record that carries the page's id.
PAGE_FIELD = "Page-ID"

LOCATED = "path string, start long, length long"
RECORD = ("page_id long, url string, record_type string, record_id string, refers_to_id string, payload_bytes long, "
          "payload_digest string, payload binary")


def store(path: str):
    """The file system of a shared folder and the path in it. Hadoop's spellings of local and
    S3 paths are understood."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))


# -- records --------------------------------------------------------------------------

def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _sha1(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record as the archive format has it; fields without a value are left out."""
    lines = [VERSION, b"WARC-Type: " + kind.encode()]
    lines += [f"{k}: {v}".encode() for k, v in fields.items() if v is not None]
    lines += [b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The response of a page, or its revisit of the page ``refers_to`` with the same payload."""
    target = None if url is None else quote(url, safe="".join(map(chr, range(33, 127))))
    again = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if again else "response", {
        "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE, "WARC-Target-URI": target,
        PAGE_FIELD: None if page_id is None else str(page_id), "WARC-Payload-Digest": _sha1(digest),
        "WARC-Profile": SAME_PAYLOAD if again else None,
        "WARC-Refers-To": record_id(refers_to, digest) if again else None,
        "Content-Type": "application/http; msgtype=response"}, head if again else head + payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields (names in lower case) and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("a WARC record ends early")
    return fields, rest[:n]


def parse_page(data: bytes) -> tuple | None:
    """A row of ``RECORD`` for a response or revisit, else None. The digest and length of a
    response are those of its payload as read; a digest field that differs is an error."""
    fields, block = parse_record(data)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    told = fields.get("warc-payload-digest", "")
    digest = base64.b32decode(told[5:]).hex() if told.startswith("sha1:") else None
    payload = n = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2] if "http" in fields.get("content-type", "") else block
        n, read = len(payload), hashlib.sha1(payload).hexdigest()
        if digest not in (None, read):
            raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
        digest = read
    page = fields.get(PAGE_FIELD.lower())
    return (None if page is None else int(page), fields.get("warc-target-uri"), kind, fields.get("warc-record-id"),
            fields.get("warc-refers-to"), n, digest, payload)


# -- writing --------------------------------------------------------------------------

class Package:
    """A ZIP package under way: one stored member of compressed records, then their index."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz"
        files, path = store(self.path)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        # its size is not known yet, so its header leaves room for more than 32 bits
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE_MEMBER), "w", force_zip64=True)
        self.size, self.lines = 0, []
        self._write(record("warcinfo", {"WARC-Record-ID": record_id(None, self.path), "WARC-Date": DATE,
                                        "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))

    def _write(self, data: bytes) -> int:
        packed = gzip.compress(data, 6, mtime=0)
        self.member.write(packed)
        self.size += len(packed)
        return len(packed)

    def add(self, url: str | None, digest: str, data: bytes) -> None:
        at = self.size
        n = self._write(data)
        place = {"offset": str(at), "length": str(n), "filename": ARCHIVE_MEMBER.removeprefix(ARCHIVES), "digest": _sha1(digest)}
        key = quote(url or "-", safe="".join(map(chr, range(33, 127))))
        self.lines.append(f"{key} {re.sub('[^0-9]', '', DATE)} {json.dumps(place)}\n")

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as index:
            for line in sorted(self.lines):
                index.write(line.encode())
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def write_packages(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as packages into a shared folder; returns
    ``path, records`` of the packages that count.

    Every row becomes a record with the html in UTF-8 (null: empty) as payload. Of rows with
    equal payloads of at least ``least`` bytes, those with the largest ``page_id`` are
    responses and the others revisit them; where all ids are null, all are responses. Each
    task writes packages of its own under new names; only those of tasks that succeeded are
    listed, so a lost executor costs its tasks again and leaves files that nothing reads.
    """
    html = text_of("html").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    # one row per payload that comes back; a broadcast only if a count proves them few
    again = small(materialize(
        rows.where("same IS NOT NULL").groupBy("same").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND newest IS NOT NULL").select("same", "newest"), "payloads_again"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))
    rows = rows.join(again, "same", "left").select("page_id", "url", "payload", F.sha1("payload").alias("digest"),
                                                   refers.alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None

        def listed(p: Package) -> pa.RecordBatch:
            path, n = p.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], names=["path", "records"])

        for part in (p for b in batches for p in text_steps([b], "payload")):
            for page_id, url, payload, digest, refers_to in zip(*(part.column(c).to_pylist() for c in (
                    "page_id", "url", "payload", "digest", "refers_to"))):
                package = package or Package(folder)
                package.add(url, digest, page_record(page_id, url, payload, digest, refers_to))
                if package.size >= PACKAGE_BYTES or len(package.lines) >= PACKAGE_RECORDS:
                    yield listed(package)
                    package = None
        if package:
            yield listed(package)

    return materialize(rows.mapInArrow(work, "path string, records long"), "packages")


# -- reading --------------------------------------------------------------------------

def _lines(read: zip_ranges.Read, start: int, length: int) -> Iterator[bytes]:
    """The lines of a stored member, read block by block."""
    held = b""
    for block in zip_ranges.blocks(read, start, length):
        *whole, held = (held + block).split(b"\n")
        yield from whole
    if held:
        yield held


def package_records(read: zip_ranges.Read, size: int) -> Iterator[tuple[int, int]]:
    """Start and length in the package of every record that its indexes list."""
    found = list(zip_ranges.members(read, size))
    archives: dict[str, tuple[int, int]] = {}
    by_name = {m.name: m for m in found}
    indexes = [m for m in found if m.name.endswith(INDEX_SUFFIX)]
    if not indexes and any(m.name.startswith(ARCHIVES) for m in found):
        raise ValueError(f"archives without an index *{INDEX_SUFFIX}")
    for index in indexes:
        for line in _lines(read, *zip_ranges.stored_range(read, index)):
            if line.startswith(b"!") or not line.strip():      # the index's own header lines
                continue
            place = json.loads(line.split(b" ", 2)[2])
            name = ARCHIVES + place["filename"]
            if name not in archives:
                if name not in by_name:
                    raise ValueError(f"the index names {name}, which the package lacks")
                archives[name] = zip_ranges.stored_range(read, by_name[name])
            begin, stored = archives[name]
            offset, length = int(place["offset"]), int(place["length"])
            if offset + length > stored:
                raise ValueError(f"a record beyond the end of {name}")
            yield begin + offset, length


def locate_records(packages: DataFrame) -> DataFrame:
    """``path, start, length`` of every record of the packages (``path``), by their
    directories and indexes alone."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inner = store(path)
                with files.open_input_file(inner) as f:
                    rows: list[tuple[int, int]] = []

                    def out() -> pa.RecordBatch:
                        return pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()),
                             pa.array([r[1] for r in rows], pa.int64())], names=["path", "start", "length"])

                    for place in package_records(lambda start, n: f.read_at(n, start), f.size()):
                        rows.append(place)
                        if len(rows) == 10_000:
                            yield out()
                            rows = []
                    if rows:
                        yield out()

    return packages.select("path").mapInArrow(work, LOCATED)


def _spans(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of neighbouring records that one range read fetches."""
    run: list[tuple[str, int, int]] = []
    for r in rows:
        if run and (r[0] != run[0][0] or not 0 <= r[1] - (run[-1][1] + run[-1][2]) <= SPAN_GAP
                    or r[1] + r[2] - run[0][1] > SPAN_BYTES):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(located: DataFrame, payloads: bool = True) -> DataFrame:
    """The responses and revisits at ``path, start, length``, as ``RECORD`` rows; without
    ``payloads`` those stay null.

    Records spread over tasks by stretches of their package, so a large package is read by
    many tasks; neighbours share a range read, and nothing else of the package is read. The
    number of tasks follows the bytes to read, which the narrow rows here don't show.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))))
            for run in _spans(rows):
                files, inner = store(run[0][0])
                with files.open_input_file(inner) as f:
                    data = f.read_at(run[-1][1] + run[-1][2] - run[0][1], run[0][1])
                pages = []
                for _, start, length in run:
                    at = start - run[0][1]
                    page = parse_page(zlib.decompress(data[at:at + length], wbits=47))
                    if page:
                        pages.append(page if payloads else (*page[:-1], None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*pages)) or [()] * len(names), types)], names=names)

    total = located.agg(F.sum("length")).first()[0] or 0
    parts = max(located.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    stretch = F.floor(F.col("start") / STRETCH)
    return located.repartition(parts, "path", stretch).sortWithinPartitions("path", "start").mapInArrow(work, RECORD)


# -- operator -------------------------------------------------------------------------

def page_digests(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records of
    pages; a revisit has the length and page of the response it names (null if that is not
    among the records)."""
    rows = materialize(records.select("page_id", "record_type", "record_id", "refers_to_id", "payload_bytes",
                                      "payload_digest"), "archive_records")
    named = rows.where("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("record_id")).distinct()
    # a response that many revisit is one row here
    first = small(materialize(
        rows.where("record_type = 'response'").join(named, "record_id", "left_semi").groupBy("record_id").agg(
            F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("full_bytes"))
        .withColumnRenamed("record_id", "refers_to_id"), "archive_revisited"))
    return rows.join(first, "refers_to_id", "left").select(
        "page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        "refers_to")


def archive_round_trip(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as ZIP-packaged web archives under ``spark.checkpoint.dir`` and read
    them back: one row of :func:`page_digests` per row of ``pages``.

    Null html is an empty payload; null ids and urls leave their fields out and come back
    null; a row that repeats a page and payload is a record of its own. Texts of any length
    are held one at a time. Other columns are ignored; an empty table writes no package and
    gives no rows. See :func:`write_packages` for ties.
    """
    folder = scratch_path(pages.sparkSession, "llm", unique_name("web_archives"))
    packages = write_packages(pages, folder, least)
    return page_digests(read_records(materialize(locate_records(packages), "archive_places"), payloads=False))

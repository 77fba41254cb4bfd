"""ZIP-packaged web archives: directories, records, the round trip over pages."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc, zip_ranges
from tessera.session import scratch_path, unique_name

SCHEMA = "page_id long, url string, html string, payload string, digest string, path string, start long"


def _read(data):
    asked = []

    def read(start, length):
        asked.append(length)
        return data[start:start + length]
    read.asked = asked
    return read


def _zip(names, comment=b"", method=zipfile.ZIP_STORED, wide=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in names.items():
            with z.open(name, "w", force_zip64=wide) as m:
                m.write(data)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("limits", [(0, 0), (100, 0), (100, 2), (0, 2)])
@pytest.mark.parametrize("comment", [b"", b"PK\5\6 not the end" * 40, b"c" * 65535])
def test_directories(monkeypatch, limits, comment):
    """Plain and ZIP64 packages, with comments that look like an end record."""
    if limits[0]:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limits[0])
    if limits[1]:
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", limits[1])
    names = {f"archive/é{i}.gz": bytes([i]) * (60 * i) for i in range(9)}
    data = _zip(names, comment, wide=bool(limits[0]))
    if any(limits):
        assert zip_ranges.END64 in data
    read = _read(data)
    found = list(zip_ranges.members(read, len(data)))
    assert [m.name for m in found] == list(names)
    for m in found:
        start, length = zip_ranges.stored_range(read, m)
        assert data[start:start + length] == names[m.name]


def test_a_directory_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(zip_ranges, "BLOCK", 100)
    names = {f"m{i}" + "x" * (i % 150): b"d" for i in range(300)}
    data = _zip(names)
    assert [m.name for m in zip_ranges.members(_read(data), len(data))] == list(names)


@pytest.mark.parametrize("data", [b"", b"PK\5\6", b"x" * 100, _zip({"a": b"b"})[:-1], b"PK\5\6" + b"\1" * 18])
def test_what_is_no_package(data):
    with pytest.raises(ValueError):
        list(zip_ranges.members(_read(data), len(data)))


def test_compressed_members_are_refused():
    data = _zip({"a": b"b" * 99}, method=zipfile.ZIP_DEFLATED)
    (m,) = zip_ranges.members(_read(data), len(data))
    with pytest.raises(ValueError, match="compressed"):
        zip_ranges.stored_range(_read(data), m)


def test_records():
    for url in ("http://a/ä b", None, "x\r\nWARC-Type: evil"):
        digest = hashlib.sha1(b"h\r\n\r\ni").hexdigest()
        row = warc.parse_page(warc.page_record(7, url, b"h\r\n\r\ni", digest, None))
        assert row[0] == 7 and row[2] == "response" and row[5:] == (6, digest, b"h\r\n\r\ni")
        again = warc.parse_page(warc.page_record(None, url, b"h\r\n\r\ni", digest, 7))
        assert again[0] is None and again[2] == "revisit" and again[4] == row[3] and again[5] is None
    assert warc.parse_page(warc.record("warcinfo", {}, b"x")) is None
    fields, block = warc.parse_record(b"WARC/1.0\r\nA: b\r\n\tc\r\nContent-Length: 1\r\n\r\nz\r\n\r\n")
    assert fields["a"] == "b c" and block == b"z"
    with pytest.raises(ValueError, match="early"):
        warc.parse_record(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nz")
    with pytest.raises(ValueError, match="differs"):
        warc.parse_page(warc.page_record(7, None, b"abc", "00" * 20, None))


def _pages():
    big, other = "é" * 600, "<p>" + "long " * 300_000
    rows = [(1, "u", big), (2, "u", big), (3, None, big), (4, "v", "short"), (5, "v", "short"), (6, "w", None), (7, "w", ""),
            (8, "x", other), (9, "x", "y" * 999), (10, "x", "y" * 999), (11, "x", "y" * 1000), (12, "x", "y" * 1000),
            (None, "z", big), (None, "z", "q" * 2000), (None, "z", "q" * 2000), (2, "u", big), (3, "u", big), (4, "v", "short")]
    return [(*r, "p", "d", "f", 1) for r in rows]


def _expected(rows, least=1000):
    data = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for page, payload in data:
        ids = [p for p, d in data if d == payload and p is not None]
        newest = max(ids, default=None) if len(payload) >= least else None
        refers = newest if newest is not None and page != newest else None
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("records, parts", [(100_000, 1), (3, 2), (1, 4)])
def test_round_trip_equals_brute_force(spark, monkeypatch, records, parts):
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", records)
    frame = spark.createDataFrame(_pages(), SCHEMA).repartition(parts)
    got = warc.archive_round_trip(frame).collect()
    assert sorted(map(tuple, got), key=str) == _expected(_pages())
    assert warc.archive_round_trip(frame.limit(0)).count() == 0


def test_packages_are_readable_archives(spark):
    """Payloads come back whole, and other readers understand package, members and index."""
    folder = scratch_path(spark, "llm", unique_name("packages"))
    frame = spark.createDataFrame(_pages(), SCHEMA).repartition(2)
    packages = warc.write_packages(frame, folder, least=10**9)
    got = warc.read_records(warc.locate_records(packages)).select("page_id", F.decode("payload", "utf-8").alias("html")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], r[2] or "") for r in _pages()), key=str)
    for r in packages.collect():
        files, path = warc.store(r["path"])
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.namelist() == [warc.ARCHIVE_MEMBER, warc.INDEX_MEMBER]
            lines = z.read(warc.INDEX_MEMBER).splitlines()
            assert len(lines) == r["records"] and all(json.loads(x.split(b" ", 2)[2])["offset"] for x in lines)


@pytest.mark.parametrize("listed", [(10_000, 0, 7), (0,), (20_000, 10_001)])
def test_packages_of_any_number_of_records(spark, tmp_path, listed):
    """Also of none, and of as many as fill the batches they are listed in."""
    for i, n in enumerate(listed):
        lines = b"".join(b'u 1 {"offset": "%d", "length": "1", "filename": "data.warc.gz"}\n' % k for k in range(n))
        (tmp_path / f"{i}.wacz").write_bytes(_zip({warc.ARCHIVE_MEMBER: b"x" * n, warc.INDEX_MEMBER: lines}))
    packages = spark.createDataFrame([(f"file://{tmp_path}/{i}.wacz",) for i in range(len(listed))], "path string").coalesce(1)
    located = warc.locate_records(packages).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("start").alias("places")).collect()
    assert sorted((r["n"], r["places"]) for r in located) == sorted((n, n) for n in listed if n)


def test_only_ranges_are_read():
    """Directory and index alone are read to find the records of a large package."""
    member = b"x" * (8 << 20)
    place = {"offset": "5", "length": "10", "filename": "data.warc.gz"}
    data = _zip({warc.ARCHIVE_MEMBER: member, warc.INDEX_MEMBER: f"u 1 {json.dumps(place)}\n".encode()})
    read = _read(data)
    ((start, length),) = warc.package_records(read, len(data))
    assert data[start - 5:start] == b"x" * 5 and length == 10 and sum(read.asked) < 100_000
    place["offset"] = str(8 << 20)
    data = _zip({warc.ARCHIVE_MEMBER: member, warc.INDEX_MEMBER: f"u 1 {json.dumps(place)}\n".encode()})
    with pytest.raises(ValueError, match="beyond"):
        list(warc.package_records(_read(data), len(data)))
    with pytest.raises(ValueError, match="without an index"):
        list(warc.package_records(_read(d := _zip({warc.ARCHIVE_MEMBER: b"x"})), len(d)))

"""Repeated windows: what byte and word deduplication have in common.

A text is a sequence of units (bytes or words), a window is ``width`` consecutive units, and
a window is repeated when the same window also starts anywhere else. Every window has a
minimiser: the smallest hash of the ``gram``-unit strings in it. Equal windows have equal
minimisers, so consecutive windows that share one (a run) travel together, as one packed
string, to the place where windows are compared. Runs whose minimiser occurs once in the
whole corpus cannot hold a repeated window and do not travel.

Steps, each a Spark job over data in the shared folder: runs of every text; minimisers that
occur in two runs or more; packed strings of those runs, each distinct one once; comparison
of the windows that share a minimiser; repeated windows back to the texts; removal. Equal
texts count once throughout: with two copies, all their windows are repeated.

A minimiser that very many different strings share would gather them in one task. Above
``HOT_STRINGS`` strings its windows are counted one by one under their digests instead, which
map-side aggregation and hashing spread; the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import IS_SPACE, flat_text, materialize, text_steps, word_spans

#: Units hashed at a time; positions in a step fit the low bits of a packed minimum.
STEP_UNITS, PLACE_BITS = 1 << 19, 20
#: Different strings of one minimiser that may meet in a task.
HOT_STRINGS = 4096
#: Bytes of packed strings compared at a time (whole minimisers).
CHUNK_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Units:
    """What a text is cut into: ``byte`` or ``word``, the window and the hashed string."""

    kind: str
    width: int
    gram: int

    def of(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """A canonical text, and the start and end byte of each unit in it.

        Words are joined by one space, so equal word sequences are equal strings.
        """
        if self.kind == "byte":
            at = np.arange(len(text) + 1)
            return text, at[:-1], at[1:]
        text = b" ".join(text.split())
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        return text, starts, ends


# -- hashing --------------------------------------------------------------------------

def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    base, inverse = _BASE, pow(_BASE, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _window_hash(values: np.ndarray, size: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of every ``size`` consecutive values."""
    up, down = powers
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    n = len(values) - size + 1
    return _mix((total[size:] - total[:n]) * down[:n])


def _word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    up, down = powers
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _minima(h: np.ndarray, size: int) -> np.ndarray:
    """The smallest of every ``size`` consecutive values, by doubling."""
    low, have = h, 1
    while have * 2 <= size:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < size:
        low = np.minimum(low[:len(h) - size + 1], low[size - have:])
    return low


def _runs(values: np.ndarray, bounds: np.ndarray, units: Units,
          powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and minimiser of every run of the rows in a flat sequence.

    A minimum carries its place, so all windows of a run share one occurrence of the
    minimiser; equal windows have it at the same offset and hence never lie in one run.
    """
    none = np.zeros(0, np.int64)
    if len(values) < units.width:
        return none, none, none
    h = _window_hash(values, units.gram, powers)
    places = np.arange(len(h), dtype=np.uint64)
    packed = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
    low = _minima(packed, units.width - units.gram + 1)
    inside = np.zeros(len(values) + 1, np.int32)
    long = np.diff(bounds) >= units.width
    inside[bounds[:-1][long]] += 1
    inside[bounds[1:][long] - units.width + 1] -= 1
    valid = np.cumsum(inside)[:len(low)] > 0
    first = valid.copy()
    first[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    first[bounds[:-1][long]] = True
    start = np.flatnonzero(first)
    at_valid = np.cumsum(valid)
    before = at_valid[start] - 1
    n = np.diff(np.r_[before, at_valid[-1] if len(at_valid) else 0])
    return start, n, (low[start] >> np.uint64(PLACE_BITS)).astype(np.int64)


def text_runs(docs: DataFrame, units: Units) -> DataFrame:
    """``doc_id, n_bytes, n_units, digest, whole_sha256, runs`` for every row of ``docs``.

    ``digest`` is of the text, ``whole_sha256`` of its canonical form (what is left when
    nothing is removed). One pass over whole texts; long ones are hashed in overlapping parts.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(2 * STEP_UNITS)
        run_type = pa.struct([("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
        for part in text_steps(batches, limit=STEP_UNITS):
            data, offsets = flat_text(part.column("text"))
            if units.kind == "byte":
                bounds, raw = offsets, data
            else:
                starts, ends, counts = word_spans(data, offsets)
                bounds = np.r_[0, np.cumsum(counts)]
            blob = data.tobytes()
            texts = [blob[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            whole = digests if units.kind == "byte" else [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            total = int(bounds[-1])
            found = []
            step = STEP_UNITS
            for a in range(0, max(total, 1), step):
                b = min(total, a + step + units.width - 1)
                if units.kind == "byte":
                    values = raw[a:b].astype(np.uint64) + np.uint64(1)
                elif b > a:
                    lo, hi = int(starts[a]), int(ends[b - 1])
                    values = _word_hash_steps(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo, powers)
                else:
                    continue
                start, n, key = _runs(values, np.unique(np.clip(bounds, a, b)) - a, units, powers)
                found.append((start + a, n, key))
            start, n, key = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
            row = np.searchsorted(bounds, start, "right") - 1
            ends_of = np.r_[0, np.cumsum(np.bincount(row, minlength=part.num_rows))]
            runs = pa.StructArray.from_arrays(
                [pa.array(key, pa.int64()), pa.array((start - bounds[row]).astype(np.int32)),
                 pa.array(n.astype(np.int32))], fields=list(run_type))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(bounds).astype(np.int64)),
                 pa.array(digests, pa.string()), pa.array(whole, pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends_of.astype(np.int32)), runs)],
                names=["doc_id", "n_bytes", "n_units", "digest", "whole_sha256", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, f"doc_id {kind}, n_bytes long, n_units long, digest string, whole_sha256 string, "
              "runs array<struct<key:long,start:int,n:int>>")


def _word_hash_steps(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                     powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Word hashes with the powers at hand, however long the bytes are."""
    room = len(powers[0]) - 1
    out, a = [], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + room, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        own = powers if hi - lo <= room else _powers(hi - lo)
        out.append(_word_hash(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo, own))
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# -- packed strings -------------------------------------------------------------------

def _strings(text: str, units: Units, runs: list) -> Iterator[tuple[dict, bytes]]:
    data, starts, ends = units.of((text or "").encode())
    for r in runs:
        yield r, data[int(starts[r["start"]]):int(ends[r["start"] + r["n"] + units.width - 2])]


def _occurrences(texts: DataFrame, units: Units) -> DataFrame:
    """``rid, key, start, n, piece`` of the candidate runs: ``piece`` is the string's digest."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches):
            rows = []
            for rid, text, runs in zip(*(part.column(c).to_pylist() for c in ("rid", "text", "runs"))):
                rows += [(rid, r["key"], r["start"], r["n"], hashlib.blake2b(s, digest_size=16).digest())
                         for r, s in _strings(text, units, runs)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["rid", "key", "start", "n", "piece"])

    return texts.select("rid", "text", "runs").mapInArrow(work, "rid long, key long, start int, n int, piece binary")


def _packed(texts: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """``key, piece, packed`` for the runs of ``wanted`` (``rid, key, start, n, piece``)."""
    by_text = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "start", "n", "piece")).alias("chosen"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches):
            rows = [(r["key"], r["piece"], s)
                    for text, runs in zip(*(part.column(c).to_pylist() for c in ("text", "chosen")))
                    for r, s in _strings(text, units, runs)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))],
                    names=["key", "piece", "packed"])

    return (texts.select("rid", "text").join(by_text, "rid").select("text", "chosen")
            .mapInArrow(work, "key long, piece binary, packed binary"))


Compare = Callable[[list, Units], list]


def _compare_chunks(packed: DataFrame, units: Units, compare: Compare) -> DataFrame:
    """``piece, s, e``: window ranges of each string that are repeated within its minimiser.

    Tasks get whole minimisers, sorted, and compare about ``CHUNK_BYTES`` at a time.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list) -> Iterator[pa.RecordBatch]:
            out = [(rows[i][1], s, e) for i, s, e in compare([r[2] for r in rows], units)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.int32()))],
                    names=["piece", "s", "e"])

        held: list = []
        size = 0
        for part in text_steps(batches, "packed", CHUNK_BYTES):
            for row in zip(*(part.column(c).to_pylist() for c in ("key", "piece", "packed"))):
                if size >= CHUNK_BYTES and held[-1][0] != row[0]:
                    yield from done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield from done(held)

    return (packed.repartition(F.col("key")).sortWithinPartitions("key")
            .mapInArrow(work, "piece binary, s int, e int"))


def _count_windows(packed: DataFrame, units: Units) -> DataFrame:
    """``piece, s, e`` like above, by counting every window under its digest."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches, "packed", CHUNK_BYTES):
            window, piece, place = [], [], []
            for p, s in zip(*(part.column(c).to_pylist() for c in ("piece", "packed"))):
                data, starts, ends = units.of(s)
                n = len(starts) - units.width + 1
                for i, (a, b) in enumerate(zip(starts[:n].tolist(), ends[units.width - 1:].tolist())):
                    window.append(hashlib.blake2b(data[a:b], digest_size=16).digest())
                    piece.append(p)
                    place.append(i)
            if window:
                yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(piece), pa.array(place, pa.int32())],
                                                 names=["window", "piece", "place"])

    rows = packed.mapInArrow(work, "window binary, piece binary, place int")
    twice = rows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return rows.join(twice, "window").select("piece", F.col("place").alias("s"), (F.col("place") + 1).alias("e"))


# -- operator -------------------------------------------------------------------------

def remove_repeats(docs: DataFrame, units: Units, compare: Compare) -> DataFrame:
    """``doc_id, n_bytes, n_units, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    rows = materialize(text_runs(docs, units).withColumn("rid", F.monotonically_increasing_id()), "repeat_runs")
    texts = rows.groupBy("digest").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"),
                                       F.min("doc_id").alias("first_id"))
    texts = materialize(texts, "repeat_texts")
    runs = (rows.join(texts.select("rid"), "rid", "left_semi")
            .select("rid", F.explode("runs").alias("r")).select("rid", "r.key", "r.start", "r.n"))
    # written, so that the join below is between two plain shuffles and a hot minimiser splits
    several = materialize(runs.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"),
                          "repeat_keys")
    candidates = (runs.join(several, "key").groupBy("rid")
                  .agg(F.collect_list(F.struct("key", "start", "n")).alias("runs")))
    chosen = candidates.join(texts.select("rid", "digest", "first_id"), "rid")
    source = docs.select(F.col("doc_id").alias("first_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("digest", F.sha2("text", 256))
    held = materialize(
        source.join(chosen, (source["digest"] == chosen["digest"])
                    & source["first_id"].eqNullSafe(chosen["first_id"])).select("rid", "text", "runs"),
        "repeat_candidates")

    found = materialize(_occurrences(held, units), "repeat_occurrences")
    pieces = found.groupBy("key", "piece").agg(
        F.min(F.struct("rid", "start", "n")).alias("at"), F.count(F.lit(1)).alias("times"))
    pieces = materialize(pieces.select("key", "piece", "at.rid", "at.start", "at.n", "times"), "repeat_pieces")
    strings = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("strings"))
    crowded = strings.where(F.col("strings") > HOT_STRINGS).select("key")
    met = strings.where(F.col("strings") > 1).select("key").join(crowded, "key", "left_anti")
    columns = ["rid", "key", "start", "n", "piece"]
    same_string = pieces.where("times > 1").select("piece", F.lit(0).alias("s"), F.col("n").alias("e"))
    marks = same_string.unionByName(
        _compare_chunks(_packed(held, pieces.join(met, "key", "left_semi").select(columns), units), units, compare)
    ).unionByName(_count_windows(_packed(held, pieces.join(crowded, "key", "left_semi").select(columns), units), units))
    # written for the same reason: a string that very many texts share
    marks = materialize(marks.groupBy("piece").agg(F.collect_list(F.struct("s", "e")).alias("marks")), "repeat_marks")
    spans = (found.select("rid", "start", "piece").join(marks, "piece")
             .select("rid", F.explode("marks").alias("m"), "start")
             .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
                 (F.col("start") + F.col("m.s")).alias("s"),
                 (F.col("start") + F.col("m.e") + (units.width - 1)).alias("e")))).alias("spans")))
    kept = _remove(held.join(spans, "rid").select("rid", "text", "spans"), units).dropDuplicates(["rid"])
    of_text = texts.select("rid", "digest", "copies").join(kept, "rid", "left").drop("rid")
    gone = (F.col("copies") > 1) & (F.col("n_units") >= units.width)
    return rows.join(of_text, "digest").select(
        "doc_id", "n_bytes", "n_units",
        F.when(gone, F.col("n_units")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"))


def _remove(texts: DataFrame, units: Units) -> DataFrame:
    """``rid, n_removed, n_spans, kept_sha256`` from ``rid, text, spans`` (unit ranges, sorted)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches):
            out = []
            for rid, text, spans in zip(*(part.column(c).to_pylist() for c in ("rid", "text", "spans"))):
                data, starts, ends = units.of((text or "").encode())
                merged: list[list[int]] = []
                for x in spans:
                    if merged and x["s"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["e"])
                    else:
                        merged.append([x["s"], x["e"]])
                left, at = [], 0
                for s, e in [*merged, [len(starts), len(starts)]]:
                    if s > at:
                        left.append(data[int(starts[at]):int(ends[s - 1])])
                    at = e
                joined = (b"" if units.kind == "byte" else b" ").join(left)
                out.append((rid, sum(e - s for s, e in merged), len(merged), hashlib.sha256(joined).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                    names=["rid", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(work, "rid long, n_removed long, n_spans long, kept_sha256 string")

"""SimHash near-duplicates with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, IS_SPACE, flat_text, materialize, row_key, text_steps, word_spans

#: Words of a shingle, hash seed and linking distance of the registered query.
SHINGLE, SEED, RADIUS = 3, 42, 2
BITS = 64


# -- fingerprints ---------------------------------------------------------------------

def _fingerprints(data: np.ndarray, offsets: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The 64-bit fingerprint of each row of a flat text, as signed integers."""
    import xxhash
    starts, ends, counts = word_spans(data, offsets)
    out = np.zeros(len(counts), np.uint64)
    if not len(starts):
        return out.view(np.int64)
    # every word followed by one space, lower case
    lower = LOWER[data]
    space = IS_SPACE[data]
    keep = ~space
    after = ends[ends < len(data)]
    keep[after[space[after]]] = True
    lower[space] = 32
    at = np.cumsum(keep) - 1
    new_starts = at[starts]
    new_ends = new_starts + (ends - starts)
    norm = lower[keep].tobytes()
    # shingles: k words on, or the whole text if it has fewer
    first_word = np.cumsum(counts) - counts
    shingles = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    total = int(shingles.sum())
    row_at = np.cumsum(shingles) - shingles
    row = np.repeat(np.arange(len(counts)), shingles)
    begin = first_word[row] + (np.arange(total) - row_at[row])
    end = np.minimum(begin + k, first_word[row] + counts[row]) - 1
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(norm[s:e], seed) for s, e in
                          zip(new_starts[begin].tolist(), new_ends[end].tolist())), np.uint64, total)
    filled = np.flatnonzero(counts)
    for r in filled.tolist():
        own = hashes[row_at[r]:row_at[r] + shingles[r]]
        ones = np.zeros(BITS, np.int64)
        for a in range(0, len(own), 1 << 15):
            bits = np.unpackbits(own[a:a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
        out[r] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (a signed 64-bit integer) for every row: one pass over whole texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches):
            data, offsets = flat_text(part.column("text"))
            fps = _fingerprints(data, offsets, shingle, seed)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, f"doc_id {kind}, fp long")


# -- covering tables ------------------------------------------------------------------

def _parity(x: int) -> int:
    return bin(x).count("1") & 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask per nonzero vector v of radius + 1 bits.

    Bit i carries the nonzero vector m(i) and is in mask v where the product m(i).v over
    two elements is 1. At most ``radius`` differing bits carry vectors that span less than
    the whole space, so some v is orthogonal to all of them: its mask hides every
    difference and the pair meets in that table, with certainty.
    """
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if _parity(m & v)) for v in range(1, 1 << (radius + 1))]


def _flips(mask: int, radius: int, bits: int = BITS) -> list[int]:
    """0 and all sets of up to radius / 2 (rounded up) bits that the mask hides."""
    free = [i for i in range(bits) if not mask >> i & 1]
    out = [0]
    if radius > 2:
        raise ValueError("radius 0, 1 or 2")
    if radius:
        out += [1 << i for i in free]
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``u, v`` that join distinct fingerprints ``fp`` within ``radius`` bits.

    Each covering table keys a fingerprint by its masked bits. In the buckets with two
    fingerprints or more, each one is sent to itself and to its one-bit changes among the
    hidden bits: two fingerprints are within two bits and differ in hidden bits only, just
    when they meet there. A meeting point has at most one member per hidden bit, all of them
    within two bits of each other, so linking them to the smallest loses nothing and no
    pair list of a hot bucket is ever made.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for t, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    # written, so that the join below is between two plain shuffles and a hot bucket splits
    multi = materialize(rows.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
                        .where("a != b").select("t", "key"), "simhash_buckets")
    flips = F.array(*[F.array(*[F.lit(_signed(f)) for f in _flips(m, radius)]) for m in masks])
    near = rows.join(multi, ["t", "key"]).select(
        "fp", "t", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    met = (near.groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
           .agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1))
    star = met.select(F.explode("members").alias("u"), F.array_min("members").alias("v"))
    return star.where("u != v").distinct()


# -- components -----------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of ``edges`` (``u, v``) reaches.

    Alternates large-star and small-star steps until the edges stop changing. Each step is
    two shuffles of the edges and is written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u != v").distinct(), "cc_edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                                                      F.lit(0))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(large.distinct(), "cc_large")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).where("u != v")
        edges = materialize(small.distinct(), "cc_small")
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


# -- operator -------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    The fingerprint has a bit set where more than half of the text's shingle hashes
    (XXH64 of lower-cased, space-joined words, repeats included) have it; a text of fewer
    words is one shingle, a text without words (null too) has fingerprint 0. Fingerprints
    at most ``radius`` bits apart are linked; ``component_id`` is the smallest ``doc_id``
    reachable (null ids count only where a component has no other). Equal texts and
    repeated rows share a fingerprint, so only distinct fingerprints are compared. Other
    columns are ignored; no rows in, no rows out.
    """
    rows = materialize(fingerprints(docs, shingle, seed), "simhash_fps")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash_distinct")
    labels = components(links(fps.select("fp"), radius))
    labelled = fps.join(labels, fps["fp"] == labels["node"], "left").select(
        "fp", "first_doc", F.coalesce("label", "fp").alias("label"))
    first = labelled.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    of_fp = labelled.join(first, "label").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def _hex(column: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def keep_one_of_group(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: the one with the smallest
    ``doc_id`` (null is last); among equal ids the text digest decides, and a repeated row
    (same ``doc_id`` and text) stays once."""
    key = "__row_key"
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_key().alias("key"))
    found = near_duplicates(docs.select(place.alias("doc_id"), "text"), **options)
    gone = found.where("doc_id != component_id").select(F.col("doc_id.key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(gone, key, "left_anti").dropDuplicates([key]).drop(key)

"""Hard negatives of anchor vectors: exact score tiles by Strassen's multiplication, mergeable heaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.centroids import finite_vector, scaled_vector
from tessera.llm.common import materialize

#: Steps per unit, positives of an anchor, negatives of a positive, and the window of negative
#: scores in percent of the positive's, of the registered query.
SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 3, (50, 95)
#: Rows of a tile, and its bytes at most (wide vectors make smaller tiles).
TILE_ROWS, TILE_BYTES = 1024, 8 << 20
#: Tiles that one partition of a written block table holds at most (more make more partitions).
PARTITION_TILES = 64
#: Anchor tiles whose heaps a task holds at a time.
HELD_TILES = 64
#: Strassen's recursion ends at tiles with so many rows, columns or inner places.
LEAF_ROWS, LEAF_INNER = 256, 8
#: Scores stay below this, so that hundredfold scores still fit in 64 bits.
SCORE_LIMIT = 1 << 56


# -- products -------------------------------------------------------------------------

def _even(x: np.ndarray) -> np.ndarray:
    """``x`` with a row and a column of zeros where it has an odd number of them."""
    return np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2))) if x.shape[0] % 2 or x.shape[1] % 2 else x


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of two int64 matrices by seven products of halves.

    Sums that pass 64 bits on the way wrap around and cancel: only the result has to fit.
    """
    rows, columns = a.shape[0], b.shape[1]
    if min(rows, columns) <= LEAF_ROWS or a.shape[1] <= LEAF_INNER:
        return a @ b
    a, b = _even(a), _even(b)
    r, i, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :i], a[:r, i:], a[r:, :i], a[r:, i:]
    b11, b12, b21, b22 = b[:i, :c], b[:i, c:], b[i:, :c], b[i:, c:]
    both = strassen(a11 + a22, b11 + b22)
    low_left = strassen(a21 + a22, b11)
    right = strassen(a11, b12 - b22)
    left = strassen(a22, b21 - b11)
    top_right = strassen(a11 + a12, b22)
    down = strassen(a21 - a11, b11 + b12)
    across = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = both + left - top_right + across
    out[:r, c:] = right + top_right
    out[r:, :c] = low_left + left
    out[r:, c:] = both - low_left + right + down
    return out[:rows, :columns]


# -- heaps ----------------------------------------------------------------------------

class Heaps:
    """The ``k`` best entries of every slot: higher scores first, then smaller ids, null ids
    last. Any heaps over the same slots merge by offering one's entries to the other."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.slot = self.score = self.id = np.zeros(0, np.int64)
        self.no_id = np.zeros(0, bool)
        #: The score that an entry of the slot has to reach.
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def offer(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, no_id: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        id_, no_id = np.concatenate([self.id, id_]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((id_, no_id, -score, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(starts, append=len(slot)))
        keep = order[place < self.k]
        self.slot, self.score = slot[place < self.k], score[keep]
        self.id, self.no_id = id_[keep], no_id[keep]
        full = slot[place == self.k - 1]
        self.least[full] = score[order[place == self.k - 1]]


# -- tiles ----------------------------------------------------------------------------

def _tiles(rows: DataFrame, n: int, width: int, name: str) -> DataFrame:
    """``rows`` (``vec_id, label, v``) as written tiles: ``block, ids, labels, cells``, the
    cells a row-major int64 matrix whose shorter vectors end in zeros."""
    size = max(1, min(TILE_ROWS, TILE_BYTES // (8 * width)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def tile(part: pa.Table) -> pa.RecordBatch:
            v = part.column("v").combine_chunks()
            lengths = v.value_lengths().to_numpy(zero_copy_only=False)
            cells = np.zeros((len(v), width), np.int64)
            cells[np.arange(width) < lengths[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
            if len(cells) and np.square(cells.astype(np.float64)).sum(axis=1).max() >= SCORE_LIMIT:
                raise ValueError("a vector's product with itself is beyond 2**56: scores need more than 64 bits")
            return pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]),
                *[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), part.column(c).combine_chunks())
                  for c in ("vec_id", "label")],
                pa.array([cells.tobytes()], pa.binary())], names=["block", "ids", "labels", "cells"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield tile(table.slice(0, size))
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield tile(pa.Table.from_batches(held))

    tiles = -(-n // size)
    parts = max(1, min(tiles, max(PARTITION_TILES, -(-tiles // PARTITION_TILES))))
    return materialize(rows.repartition(parts).mapInArrow(
        pack, "block string, ids array<long>, labels array<long>, cells binary"), name)


def _numbers(batch: pa.RecordBatch, column: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """A list cell of longs as numbers (null: 0), and where it is null."""
    values = batch.column(column)[row].values
    return values.fill_null(0).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)


def _cells(batch: pa.RecordBatch, column: str, row: int, n: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), np.int64).reshape(n, -1)


def _search(pairs: DataFrame, k: int, slots_each: int, windowed: bool) -> DataFrame:
    """``block, slot, id, score``: the heaps of all tile pairs, one set for each task and
    anchor tile (or more, where a task meets many anchor tiles in turn)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, Heaps] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for block, h in heaps.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(h.slot), pa.string()), pa.array(h.slot), pa.array(h.id, mask=h.no_id),
                     pa.array(h.score)], names=["block", "slot", "id", "score"])
            heaps.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column("block")[r].as_py()
                (ids, _), (labels, _) = _numbers(batch, "ids", r), _numbers(batch, "labels", r)
                (c_ids, c_null), (c_labels, _) = _numbers(batch, "c_ids", r), _numbers(batch, "c_labels", r)
                scores = strassen(_cells(batch, "cells", r, len(ids)), _cells(batch, "c_cells", r, len(c_ids)).T)
                if block not in heaps and len(heaps) == HELD_TILES:
                    yield from emit()
                heap = heaps.setdefault(block, Heaps(len(ids) * slots_each, k))
                same = labels[:, None] == c_labels
                if not windowed:
                    a, c = np.nonzero(same & (scores >= heap.least[:, None]))
                    other = (ids[a] != c_ids[c]) | c_null[c]
                    a, c = a[other], c[other]
                    heap.offer(a, scores[a, c], c_ids[c], c_null[c])
                    continue
                lo, hi = np.ones((len(ids), slots_each), np.int64), np.zeros((len(ids), slots_each), np.int64)
                windows = batch.column("windows")[r].values
                slot = windows.field("slot").to_numpy(zero_copy_only=False)
                lo.ravel()[slot] = windows.field("lo").to_numpy(zero_copy_only=False)
                hi.ravel()[slot] = windows.field("hi").to_numpy(zero_copy_only=False)
                least = np.maximum(lo, heap.least.reshape(lo.shape))
                lowest = np.where(least <= hi, least, np.iinfo(np.int64).max).min(axis=1)
                a, c = np.nonzero(~same & (scores >= lowest[:, None]) & (scores <= hi.max(axis=1)[:, None]))
                score = scores[a, c]
                entry, place = np.nonzero((score[:, None] >= least[a]) & (score[:, None] <= hi[a]))
                heap.offer(a[entry] * slots_each + place, score[entry], c_ids[c[entry]], c_null[c[entry]])
        yield from emit()

    return pairs.mapInArrow(work, "block string, slot long, id long, score long")


def _best(found: DataFrame, k: int, rank: str) -> DataFrame:
    """The heaps of all tasks merged: the first ``k`` of each slot, numbered from 1."""
    order = Window.partitionBy("block", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


# -- operator -------------------------------------------------------------------------

def hard_negatives(vectors: DataFrame, anchor: Column | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors``: ``vec_id, embedding, label``. Rows with a null label, a null vector, or a
    null or non-finite component take no part. Components become ``floor(scale * x)``; a
    score is the integer inner product (shorter vectors end in zeros). Rows where ``anchor``
    holds (default: ids divisible by 50) are anchors. Of the rows with the anchor's label
    and another id, the first ``positives`` by score (ties: smaller id, null ids last) are
    its positives; for each, the first ``negatives`` rows of other labels follow whose score
    lies within ``window`` percent of the positive's, bounds included. An anchor without
    positives, or a positive without negatives, gives no row. Repeated rows are rows of
    their own, as anchors too; rows with the anchor's own id are never its positives. Other
    columns are ignored; an empty table gives an empty result. Vectors whose product with
    themselves passes 2**56 raise an error.

    The anchors are a stated query set, held against all rows tile against tile. A task
    keeps heaps of its anchor tiles, not scores, and the heaps of all tasks merge by slot.
    One pass finds the positives, whose scores set the windows of the second.
    """
    is_anchor = F.coalesce(F.expr("vec_id % 50 = 0") if anchor is None else anchor, F.lit(False))
    rows = materialize(vectors.where(F.col("label").isNotNull() & finite_vector("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        scaled_vector("embedding", scale).alias("v"), is_anchor.alias("anchor")), "negatives_rows")
    n, n_anchors, width = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    anchors = _tiles(rows.where("anchor").select("vec_id", "label", "v"), n_anchors, width, "anchor_tiles")
    candidates = _tiles(rows.select("vec_id", "label", "v"), n, width, "candidate_tiles").selectExpr(
        "ids AS c_ids", "labels AS c_labels", "cells AS c_cells")

    low, high = window
    score = F.col("score")
    found = _best(_search(anchors.crossJoin(candidates), positives, 1, False), positives, "place")
    of_anchor = anchors.select("block", F.posexplode("ids").alias("slot", "anchor_id"))
    chosen = materialize(found.join(of_anchor, ["block", "slot"]).select(
        "block", ((F.col("slot") * positives) + F.col("place") - 1).alias("slot"), "anchor_id",
        F.col("id").alias("positive_id"), score.alias("positive_score"),
        _floor_div(low * score + 99).alias("lo"), _floor_div(high * score).alias("hi")), "negatives_windows")
    # at most tile rows x positives windows an anchor tile
    windows = chosen.groupBy("block").agg(F.collect_list(F.struct("slot", "lo", "hi")).alias("windows"))
    near = _search(anchors.join(windows, "block").crossJoin(candidates), negatives, positives, True)
    ranked = _best(near, negatives, "rank")
    return ranked.join(chosen, ["block", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        score.alias("negative_score"))


def _floor_div(x: Column) -> Column:
    """The floor of a long over 100, in longs throughout."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))

"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_rows, flat_text, materialize, row_key, text_of, text_steps, without
from tessera.session import scratch_path, unique_name

#: Words of a window in the registered query.
WINDOW = 10
#: Text bytes of an index shard (always whole documents).
SHARD_BYTES = 2 << 20
#: Shards in a row group and in an Arrow batch of the index: what a task writes or reads of it at a time.
GROUP_SHARDS = 8
#: Phrases that go to the executors at a time: the bound of what is broadcast. Further
#: phrases are asked in further blocks.
BLOCK_PHRASES = 20_000
#: Phrase candidates checked at a time inside a task.
STEP_CANDIDATES = 1 << 18

#: Word bytes: digits, letters (A-Z become a-z) and everything outside ASCII.
TO_WORD = np.full(256, 32, np.uint8)
TO_WORD[48:58] = np.arange(48, 58)
TO_WORD[65:91] = np.arange(97, 123)
TO_WORD[97:123] = np.arange(97, 123)
TO_WORD[128:] = np.arange(128, 256)


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column in order, and how many each row has (null: none)."""
    data, offsets = flat_text(column)
    clean = TO_WORD[data]
    words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(clean)))
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(words)), np.diff(np.asarray(words.offsets)))
    real_np = real.to_numpy(zero_copy_only=False)
    return flat.filter(real), np.bincount(row[real_np], minlength=len(words))


# -- index ----------------------------------------------------------------------------

def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all words of ``docs``, written to the shared folder.

    One row per shard of whole documents: ``shard, doc_ids, n_words, terms, counts,
    postings``. The postings of a term are its positions in the shard, ascending, stored as
    32-bit differences term after term. Documents lie one position apart, so no phrase
    spans two of them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        for part in text_steps(batches, limit=SHARD_BYTES):
            words, counts = split_words(part.column("text"))
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(codes, kind="stable")
            positions = (np.arange(len(codes)) + row)[order]  # one free place after each document
            per_term = np.bincount(codes, minlength=len(coded.dictionary))
            steps = np.diff(positions, prepend=0)
            begins = (np.cumsum(per_term) - per_term)[per_term > 0]
            steps[begins] = positions[begins]
            yield pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]),
                pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")),
                pa.array([counts.astype(np.int32)]),
                pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()),
                                         coded.dictionary.cast(pa.string())),
                pa.array([per_term.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([steps.astype("<i4").tobytes()], pa.binary())],
                names=["shard", "doc_ids", "n_words", "terms", "counts", "postings"])

    schema = (f"shard string, doc_ids array<{kind}>, n_words array<int>, terms array<string>, "
              "counts array<int>, postings binary")
    return materialize(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                       .mapInArrow(work, schema), "positional_index", GROUP_SHARDS)


# -- phrases --------------------------------------------------------------------------

def phrases_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of ``items`` (``item_id, text``), numbered, and who has them.

    Phrases are ``number, block, phrase`` (words joined by one space), dealt evenly to as few
    blocks as hold about ``BLOCK_PHRASES`` each; owners are ``number, item_id``. Both are written tables.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches):
            flat, counts = split_words(part.column("text"))
            words, ends = flat.to_pylist(), np.cumsum(counts).tolist()
            ids, found = [], []
            for item, n, end in zip(part.column("item_id").to_pylist(), counts.tolist(), ends):
                own = words[end - n:end]
                windows = {" ".join(own[a:a + window]) for a in range(max(n - window + 1, min(n, 1)))}
                found += windows
                ids += [item] * len(windows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())],
                                             names=["item_id", "phrase"])

    owned = materialize(
        items.select(text_of("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(work, "item_id string, phrase string").distinct(), "phrase_items")
    distinct = materialize(owned.select("phrase").distinct(), "distinct_phrases")
    blocks = max(1, -(-distinct.count() // BLOCK_PHRASES))
    phrases = materialize(distinct.repartition(blocks).select(
        F.monotonically_increasing_id().alias("number"), F.spark_partition_id().alias("block"), "phrase"), "phrases")
    return phrases, materialize(owned.join(phrases, "phrase").select("number", "item_id"), "phrase_owners")


class Phrases:
    """A block of phrases as number arrays: a term number per place, -1 beyond the end."""

    def __init__(self, numbers: np.ndarray, phrases: list[str]):
        self.numbers = numbers
        phrases = [p.split(" ") for p in phrases]
        self.size = np.array([len(p) for p in phrases], np.int64)
        self.vocabulary = sorted({w for p in phrases for w in p})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.terms = np.full((len(phrases), int(self.size.max())), -1, np.int64)
        for i, p in enumerate(phrases):
            self.terms[i, :len(p)] = [number[w] for w in p]

    def search(self, terms: pa.Array, counts: np.ndarray, postings: np.ndarray,
               slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places in the block and start positions of all matches in one shard.

        Each phrase starts from the postings of its rarest term in the shard, moved to the
        phrase's start, and keeps the starts that the next rarer term confirms, and so on.
        With ``slop`` every other term may lie that many positions off its place.
        """
        none = np.zeros(0, np.int64)
        number = pc.fill_null(pc.index_in(terms, value_set=pa.array(self.vocabulary, terms.type)), -1)
        number = number.to_numpy(zero_copy_only=False).astype(np.int64)
        have = np.zeros(len(self.vocabulary) + 1, np.int64)
        have[number[number >= 0]] = counts[number >= 0]
        have[-1] = np.iinfo(np.int64).max
        alive = np.flatnonzero((have[self.terms] > 0).all(1))
        if not len(alive):
            return none, none
        # the postings of the block's terms: (term, position) ascending in one number
        wanted = np.repeat(number, counts)
        at = np.cumsum(postings)  # differences run on over term borders ...
        begins = np.cumsum(counts) - counts
        at -= np.repeat(at[begins] - postings[begins], counts)  # ... so each term starts anew
        far = int(at.max()) + self.terms.shape[1] + 2 * slop + 2
        keys = np.sort((wanted * far + at)[wanted >= 0])
        first = np.searchsorted(keys, np.arange(len(self.vocabulary)) * far)
        by_rarity = np.argsort(have[self.terms[alive]], axis=1, kind="stable")
        rarest = self.terms[alive, by_rarity[:, 0]]
        found_p, found_s = [], []
        load = np.cumsum(have[rarest])
        a = 0
        while a < len(alive):
            b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + STEP_CANDIDATES, "right")))
            n = have[rarest[a:b]]
            local = np.repeat(np.arange(a, b), n)
            inside = np.arange(len(local)) - np.repeat(np.cumsum(n) - n, n)
            start = keys[first[rarest[local]] + inside] - rarest[local] * far - by_rarity[local, 0]
            for step in range(1, self.terms.shape[1]):
                place = by_rarity[local, step]
                term = self.terms[alive[local], place]
                goal = np.where(term >= 0, term, 0) * far + start + place
                lowest = np.maximum(goal - slop, np.where(term >= 0, term, 0) * far)
                hit = np.searchsorted(keys, lowest)
                ok = (term < 0) | (keys[np.minimum(hit, len(keys) - 1)] <= goal + slop) & (hit < len(keys)) & (
                    start + place + slop >= 0)
                local, start = local[ok], start[ok]
            found_p.append(alive[local])
            found_s.append(start)
            a = b
        return np.concatenate(found_p), np.concatenate(found_s)


HITS = "shard string, row int, spans array<struct<s:int,e:int>>, numbers array<bigint>"


def find_phrases(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """``shard, row, spans, numbers`` of the documents in which ``phrases`` occur, written.

    Every shard is asked for every phrase, a block at a time: a block is one broadcast row of
    about ``BLOCK_PHRASES`` phrases, and postings stay where they are. Spans are merged
    word ranges (end exclusive); a document has one row per block of phrases found in it.
    """
    spark = index.sparkSession
    path = scratch_path(spark, "llm", unique_name("phrase_hits"))
    own = [r["block"] for r in phrases.select("block").distinct().collect()]  # names of blocks only
    for block in own:
        row = (phrases.where(F.col("block") == block).groupBy("block")
               .agg(F.collect_list(F.struct("number", "phrase")).alias("phrases")))
        with arrow_rows(spark, GROUP_SHARDS):
            _search(index, row, slop).write.parquet(f"{path}/block={block}")
    return spark.read.schema(HITS).parquet(path) if own else spark.createDataFrame([], HITS)


def _search(index: DataFrame, block: DataFrame, slop: int) -> DataFrame:
    """Hits of the one row of ``block`` in all shards."""
    asked = index.select("shard", "n_words", "terms", "counts", "postings").crossJoin(F.broadcast(block.select("phrases")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = None
        for batch in batches:
            for r in range(batch.num_rows):
                terms = batch.column("terms")[r].values
                counts = batch.column("counts")[r].values.to_numpy(zero_copy_only=False).astype(np.int64)
                steps = np.frombuffer(batch.column("postings")[r].as_py(), "<i4").astype(np.int64)
                if not len(steps):
                    continue
                if phrases is None:  # the same in every row
                    own = batch.column("phrases")[r].values
                    phrases = Phrases(own.field("number").to_numpy(zero_copy_only=False), own.field("phrase").to_pylist())
                place, start = phrases.search(terms, counts, steps, slop)
                if not len(place):
                    continue
                n_words = batch.column("n_words")[r].values.to_numpy(zero_copy_only=False).astype(np.int64)
                base = np.cumsum(n_words + 1) - (n_words + 1)
                start = np.maximum(start, 0)
                row = np.searchsorted(base, start, "right") - 1
                begin = start - base[row]
                end = np.minimum(begin + phrases.size[place], n_words[row])
                order = np.lexsort((begin, row))
                out: dict[int, tuple[list, set]] = {}
                for i in order.tolist():
                    spans, numbers = out.setdefault(int(row[i]), ([], set()))
                    if spans and begin[i] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], int(end[i]))
                    else:
                        spans.append([int(begin[i]), int(end[i])])
                    numbers.add(int(phrases.numbers[place[i]]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("shard")[r].as_py()] * len(out)), pa.array(list(out), pa.int32()),
                    pa.array([[{"s": s, "e": e} for s, e in v[0]] for v in out.values()],
                             pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                    pa.array([sorted(v[1]) for v in out.values()], pa.list_(pa.int64()))],
                    names=["shard", "row", "spans", "numbers"])

    return asked.mapInArrow(work, HITS)


# -- operator -------------------------------------------------------------------------

def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the hit word
    ``spans`` and ``items``, one row per row of ``docs``.

    Words are lower-cased runs of digits, letters and non-ASCII characters. A phrase is
    ``window`` consecutive words of an item, or a shorter item as a whole; items without
    words (null too) have none. Words of a document inside an occurrence are hit. The
    postings of all words of ``docs`` are written once; phrases are made and numbered in Spark
    and go to the executors in blocks of bounded size, each against the whole index; their
    owners are joined to the hits by number. Null texts have no words; a null
    ``item_id`` reads as the empty string; repeated items count once; other columns are
    ignored. An empty benchmark hits nothing.
    """
    index = build_index(docs)
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "d")).select(
        "shard", "row", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
    phrases, owners = phrases_of(benchmark, window)
    hits = find_phrases(index, phrases, slop)
    spans = hits.groupBy("shard", "row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    items = (hits.select("shard", "row", F.explode("numbers").alias("number")).join(owners, "number")
             .groupBy("shard", "row").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    full = rows.join(spans.join(items, ["shard", "row"]), ["shard", "row"], "left").withColumns({
        "spans": F.coalesce("spans", F.array()), "items": F.coalesce("items", F.array())})
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    union = F.aggregate("spans", zero, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["upto"], x["s"]))).alias("n"),
        F.greatest(acc["upto"], x["e"]).alias("upto")), lambda acc: acc["n"])
    return full.withColumn("n_hit", union.cast("long")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "spans", "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark phrase occurs."""
    found = contamination(docs.select(row_key().alias("doc_id"), "text"), benchmark, **options)
    return without(docs, found.where("contaminated").select(F.col("doc_id").alias("key")))

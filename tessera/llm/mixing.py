"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, same, small, text_of

#: Words of a text for its size: runs of anything but white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The hash has LEVELS * LEVEL_BITS bits; each level splits a bucket into 2**LEVEL_BITS.
LEVELS, LEVEL_BITS = 4, 15
HASH_BITS = LEVELS * LEVEL_BITS


def mix_to_weights(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    Sources in code point order (null last) take ``weights`` in turn and share ``budget``
    times all words; no target exceeds ``max_epochs`` times its source's words, and what
    lies above goes to the others by weight. A source's target is its whole epochs plus a
    rest; the rest is the set of documents whose hash lies under a threshold. Thresholds
    come from histograms: words by (source, hash bucket), the bucket in which the running
    sum crosses the rest, then a histogram of that bucket alone, four times 15 bits deep.
    The last hash value on the threshold is in or out, whichever lands nearer. Nothing is
    sorted or collected; each histogram has at most 32,768 buckets per source.

    The hash is over id and text, so reruns agree and rows with null ids still spread;
    repeated rows share one hash and are taken together. Null texts have size 0 and take 0.
    A source without words has target 0. Other columns are ignored.
    """
    sized = materialize(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of("text"), F.lit(WORD_PATTERN)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                             text_of("text"))), 1, HASH_BITS // 4), 16, 10)
        .cast("long").alias("h")), "mix_sizes")
    state = materialize(source_targets(sized, weights, budget, max_epochs), "mix_targets")
    for level in range(LEVELS):
        state = materialize(_refine(sized, state, level), f"mix_level{level}")
    near = small(state)
    h = F.col("h")
    inside = (F.col("open") | (h < F.col("prefix"))
              | ((h == F.col("prefix")) & (F.col("last_words") - F.col("rest") < F.col("rest"))))
    return sized.join(near, same(sized, near, "source")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("epochs") + F.when(inside, 1).otherwise(0))).alias("taken"))


def source_targets(sized: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: int) -> DataFrame:
    """One row per source: its size, target, whole epochs and rest.

    The level at which the capped shares use up the budget is found over the sources in the
    order in which they reach their caps. Both orders run over ranges of sources, one task a
    range; only the budget and the level go through the driver.
    """
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix_sources")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * budget
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = _running(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    caps = place.select(
        "source", "source_size", (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
        F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).alias("w"))
    caps = materialize(caps.withColumn("ratio", F.col("cap") / F.col("w")), "mix_caps")
    all_w = caps.agg(F.sum("w")).first()[0]
    steps = _running(caps, [F.col("ratio"), F.col("source").asc_nulls_last()],
                     {"upto_cap": F.col("cap"), "upto_w": F.col("w")})
    level = ((F.lit(total) - (F.col("upto_cap") - F.col("cap")))
             / (F.lit(all_w) - (F.col("upto_w") - F.col("w"))))
    first = steps.where(level <= F.col("ratio")).agg(F.min(F.struct("ratio", level.alias("level")))).first()[0]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first["level"]) * F.col("w"))
    out = caps.select("source", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return out.select("source", "source_size", "target", epochs.cast("long").alias("epochs"),
                      (F.col("target") - epochs * F.col("source_size")).alias("rest"),
                      F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("open"),
                      F.lit(0).cast("long").alias("last_words"))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running ``sums`` (name -> summed column) over ``order``, own row included.

    Rows are split into ranges of the order; the sums of whole ranges (one row a partition)
    carry over to the next ones.
    """
    part = "__range"
    ranged = materialize(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "mix_ranges")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    of_range = ranged.groupBy(part).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    carried = of_range.select(part, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    return (own.join(carried, part).withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums})
            .drop(part, *[f"__{n}" for n in sums]))


def _refine(sized: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """Split each source's boundary bucket once more and keep the part the rest ends in.

    ``open`` marks a source whose rest covers all its documents.
    """
    near = small(state.where("NOT open"))
    shift = HASH_BITS - LEVEL_BITS * (level + 1)
    bucket = F.shiftright("h", shift)
    hist = (sized.join(near, same(sized, near, "source")
                       & (F.shiftright(sized["h"], shift + LEVEL_BITS) == near["prefix"]))
            .groupBy(sized["source"].alias("source"), bucket.alias("bucket"))
            .agg(F.sum("size").alias("words"))
            .select(F.col("source").alias("h_source"), "bucket", "words"))
    running = F.sum("words").over(Window.partitionBy("h_source").orderBy("bucket"))
    crossed = hist.withColumn("upto", running)
    joined = crossed.join(state, crossed["h_source"].eqNullSafe(state["source"]))
    bound = (joined.where(F.col("upto") > F.col("rest")).groupBy("h_source")
             .agg(F.min(F.struct("bucket", "words", "upto")).alias("cut")))
    out = state.join(bound, state["source"].eqNullSafe(bound["h_source"]), "left")
    return out.select(
        "source", "source_size", "target", "epochs",
        F.coalesce(F.col("rest") - (F.col("cut.upto") - F.col("cut.words")), F.col("rest")).alias("rest"),
        F.coalesce(F.col("cut.bucket"), F.col("prefix")).alias("prefix"),
        (F.col("open") | F.col("cut").isNull()).alias("open"),
        F.coalesce(F.col("cut.words"), F.lit(0)).cast("long").alias("last_words"))

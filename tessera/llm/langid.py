"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_key, text_steps, without

#: Width of the vectors and seed of the letter vectors.
DIM, VECTOR_SEED = 1024, 7
#: Text bytes and rows worked on at a time.
STEP_TEXT, STEP_ROWS = 1 << 20, 512
#: Characters of a long text, and distinct trigrams, worked on at a time.
PIECE, GRAM_BLOCK = 1 << 20, 1 << 14
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letter_vectors(points: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """A random vector of +1 and -1 per code point, the same in every process."""
    out = np.empty((len(points), dim), np.int8)
    for i, p in enumerate(points.tolist()):
        out[i] = np.random.Generator(np.random.PCG64([seed, p])).integers(0, 2, dim, np.int8) * 2 - 1
    return out


def _ngrams(texts: list, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct letters, distinct trigrams (three letter numbers each), and for every
    occurrence its text and trigram.

    Letters are lower case; whatever stands between words counts as one boundary sign (0),
    also at both ends. Trigrams with a boundary in the middle are left out.
    """
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    flat = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    row = np.repeat(np.arange(len(texts)), sizes)
    # a boundary before each text and after the last letter: rows get one extra sign each
    ends = np.cumsum(sizes)
    seq = np.insert(np.where(letters[flat], flat, 0), ends, 0)
    rows = np.insert(row, ends, np.arange(len(texts)))
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    keep = (seq != 0) | (np.r_[1, seq[:-1]] != 0) & ~first if len(seq) else first
    seq, rows = seq[keep], rows[keep]
    start = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(start & (seq != 0))
    seq, rows = np.insert(seq, at, 0), np.insert(rows, at, rows[at])
    used = np.flatnonzero(np.bincount(seq, minlength=1)) if len(seq) else np.zeros(0, np.int64)
    number = np.zeros(0x110000, np.int64)
    number[used] = np.arange(len(used))
    ids = number[seq]
    n = max(len(used), 1)
    ok = (rows[2:] == rows[:-2]) & (seq[1:-1] != 0) if len(seq) > 2 else np.zeros(0, bool)
    code = ((ids[:-2] * n + ids[1:-1]) * n + ids[2:])[ok] if len(seq) > 2 else np.zeros(0, np.int64)
    owner = rows[:-2][ok] if len(seq) > 2 else np.zeros(0, np.int64)
    if n ** 3 <= 1 << 24:
        grams = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(n ** 3, np.int64)
        place[grams] = np.arange(len(grams))
        gram = place[code]
    else:
        grams, gram = np.unique(code, return_inverse=True)
    triples = np.stack([grams // (n * n), grams // n % n, grams % n], 1)[:len(grams) if len(code) else 0]
    return used, triples, owner, gram


def _bundles(texts: list, letters: np.ndarray, dim: int, seed: int, groups: np.ndarray,
             n_groups: int) -> np.ndarray:
    """The bundle of the trigram vectors of each group of texts.

    A trigram binds its letters by product after shifting the first twice and the second
    once. Trigrams are worked on in blocks, so memory does not follow their variety.
    """
    used, triples, owner, gram = _ngrams(texts, letters)
    base = _letter_vectors(used, dim, seed)
    once, twice = np.roll(base, 1, 1), np.roll(base, 2, 1)
    out = np.zeros((n_groups, dim), np.float64)
    group = groups[owner]
    for a in range(0, len(triples), GRAM_BLOCK):
        block = triples[a:a + GRAM_BLOCK]
        inside = slice(None) if len(triples) <= GRAM_BLOCK else (gram >= a) & (gram < a + len(block))
        counts = np.bincount(group[inside] * len(block) + gram[inside] - a, minlength=n_groups * len(block))
        vectors = twice[block[:, 0]] * once[block[:, 1]] * base[block[:, 2]]
        out += counts.reshape(n_groups, -1).astype(np.float32) @ vectors.astype(np.float32)
    return out


def _pieces(texts: list) -> Iterator[tuple[list, list]]:
    """Runs of texts with their numbers. A text longer than ``PIECE`` characters is cut at
    spaces, which changes no trigram: a space is a boundary, and so are both ends."""
    run, owners, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            to = len(text)
            if to - at > PIECE:
                to = text.rfind(" ", at, at + PIECE) + 1 or text.find(" ", at + PIECE) + 1 or to
            if size + to - at > PIECE and run:
                yield run, owners
                run, owners, size = [], [], 0
            run.append(text[at:to])
            owners.append(i)
            size += to - at
            at = to
    if run:
        yield run, owners


def _grouped(texts: list, letters: np.ndarray, dim: int, seed: int, groups: list, n_groups: int) -> np.ndarray:
    """The bundle of each group of texts, a piece at a time."""
    out = np.zeros((n_groups, dim), np.float64)
    for run, owners in _pieces(texts):
        out += _bundles(run, letters, dim, seed, np.array([groups[i] for i in owners], np.int64), n_groups)
    return out


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_steps(batches, limit=STEP_TEXT):
        for a in range(0, part.num_rows, STEP_ROWS):
            yield part.slice(a, STEP_ROWS)


def learn_profiles(labelled: DataFrame, dim: int = DIM, seed: int = VECTOR_SEED) -> dict[str, np.ndarray]:
    """One bundle per value of ``lang``, from ``text`` of all rows with a non-null ``lang``.

    Tasks add up trigram bundles by language; Spark sums the partial bundles element by
    element. Only languages x ``dim`` numbers reach the driver.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = _letter_table(), {}
        for part in _steps(batches):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            groups = [names.index(x) for x in langs]
            for name, v in zip(names, _grouped(part.column("text").to_pylist(), letters, dim, seed, groups, len(names))):
                sums[name] = sums.get(name, 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([np.rint(v).astype(np.int64) for v in sums.values()])],
                names=["lang", "bundle"])

    rows = (labelled.where("lang IS NOT NULL")
            .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
            .mapInArrow(work, "lang string, bundle array<long>")
            .select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
            .select("lang", F.col("v.x").alias("v")))
    return {r["lang"]: np.array(r["v"], np.float64) for r in rows.collect()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], seed: int = VECTOR_SEED) -> DataFrame:
    """``docs`` columns ``doc_id`` and ``held_out`` (if there) with ``lang_pred`` and ``score``.

    The score is the cosine of the text's bundle and the profile, at least 0; the best
    language wins, the first by name on a tie. A text that is null or has no letters is
    ``und`` with score 0, and so is every text when there are no profiles.
    """
    names = sorted(k for k, v in profiles.items() if np.any(v))
    matrix = np.array([profiles[k] / np.linalg.norm(profiles[k]) for k in names], np.float32)
    dim = matrix.shape[1] if names else 0
    carried = [c for c in ("doc_id", "held_out") if c in docs.columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_table()
        for part in _steps(batches):
            pred, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            if names:
                own = _grouped(part.column("text").to_pylist(), letters, dim, seed, range(part.num_rows), part.num_rows)
                length = np.linalg.norm(own, axis=1)
                cos = own @ matrix.T / np.where(length > 0, length, 1)[:, None]
                best = cos.argmax(1)
                score = np.where(length > 0, np.clip(cos[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                pred = [names[b] if n > 0 else UNKNOWN for b, n in zip(best.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(pred, pa.string()),
                                              pa.array(score)], names=[*carried, "lang_pred", "score"])

    schema = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried] + ["lang_pred string", "score double"]
    return docs.select(*carried, F.col("text").cast("string").alias("text")).mapInArrow(work, ", ".join(schema))


def fold(column: str = "doc_id", parts: int = 4):
    """The fold of a document; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(0))


def language_of(docs: DataFrame, held_out_fold: int = 2, dim: int = DIM) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Profiles are learned from ``text`` and non-null ``lang`` of the documents outside the
    held-out fold; predictions use the text alone. Every text is read whole. Repeated rows
    get equal answers; no rows in, no rows out; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", (fold() == held_out_fold).alias("held_out"))
    return identify(rows, _profiles_of(docs, held_out_fold, dim))


def _profiles_of(docs: DataFrame, held_out_fold: int = 2, dim: int = DIM) -> dict[str, np.ndarray]:
    return learn_profiles(docs.where(fold() != held_out_fold).select("text", "lang"), dim)


def keep_identified(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language: letters, and a score above
    ``least_score``."""
    found = identify(docs.select(row_key().alias("doc_id"), "text"), _profiles_of(docs))
    gone = found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") <= least_score))
    return without(docs, gone.select(F.col("doc_id").alias("key")))

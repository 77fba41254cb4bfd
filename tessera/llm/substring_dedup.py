"""Removal of repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm.repeats import Units, remove_repeats

#: Words of a window, and of the strings whose hashes are compared for the minimiser.
WIDTH, GRAM = 35, 18


def sort_windows(strings: list[bytes], units: Units) -> list[tuple[int, int, int]]:
    """``(string, start, end)``: ranges of window starts whose window occurs again.

    All windows of a bucket's strings are sorted; equal neighbours are counted exactly.
    """
    windows: list[bytes] = []
    place: list[tuple[int, int]] = []
    for i, s in enumerate(strings):
        data, starts, ends = units.of(s)
        n = len(starts) - units.width + 1
        windows += [data[a:b] for a, b in zip(starts[:n].tolist(), ends[units.width - 1:].tolist())]
        place += [(i, j) for j in range(n)]
    order = sorted(range(len(windows)), key=windows.__getitem__)
    repeated = sorted({place[x] for a, b in zip(order, order[1:]) if windows[a] == windows[b] for x in (a, b)})
    out: list[list[int]] = []
    for i, j in repeated:
        if out and out[-1][0] == i and out[-1][2] == j:
            out[-1][2] = j + 1
        else:
            out.append([i, j, j + 1])
    return [tuple(x) for x in out]


def remove_repeated_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_units, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    Words are runs of anything but white space (null: none). Every word inside a window of
    ``width`` words whose sequence also starts anywhere else in the corpus, the same text
    included, is removed. Consecutive windows with one minimiser travel as one packed string
    to its bucket (:mod:`tessera.llm.repeats`), where sorting counts windows exactly.
    Repeated rows are copies of each other. Texts of fewer words stay whole. The digest is
    of the kept words joined by one space. Other columns are ignored; no rows in, no rows
    out.
    """
    return remove_repeats(docs, Units("word", width, gram), sort_windows)

"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.repeats import Units, remove_repeats

#: Bytes of a repeated string, and of the strings whose hashes route it.
WIDTH, GRAM = 400, 200


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence in which every string ends with a sign of its own.

    Prefix doubling; only suffixes that are not yet unique are sorted again.
    """
    n = len(symbols)
    pad = np.r_[symbols.astype(np.uint64), np.zeros(3, np.uint64)]
    key = (pad[:n] << np.uint64(48)) | (pad[1:n + 1] << np.uint64(32)) | (pad[2:n + 2] << np.uint64(16)) | pad[3:n + 3]
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    slots = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
    k = 4
    while len(slots):
        own = order[slots]
        pair = rank[own] * n + rank[own + k]
        by = np.argsort(pair, kind="stable")
        own, pair = own[by], pair[by]
        order[slots] = own
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        rank[own] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        slots = slots[~(fresh & np.r_[fresh[1:], True])]
        k *= 2
    return order


def long_common_prefixes(order: np.ndarray, symbols: np.ndarray, least: int) -> np.ndarray:
    """For each rank, whether its suffix shares ``least`` symbols or more with the one before.

    Breadth first over the strings that occur, shortest first: level l holds the rank
    intervals of strings of length l whose upper border was found on that level. Extending
    such a string by one symbol to the left (by the transform's last-to-first mapping) gives
    an interval one level on; if its upper border has no common-prefix value yet, the value
    is l, and the interval joins the next level. Values come in increasing order, so the
    search stops at ``least``: borders without a value by then are the long ones.
    """
    n = len(order)
    before = symbols[order - 1]
    by_symbol = np.argsort(before.astype(np.uint16), kind="stable")
    last_to_first = np.empty(n, np.int64)
    last_to_first[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following = np.full(n, n, np.int64)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding = np.full(n, -1, np.int64)
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]

    open_border = np.ones(n + 1, bool)
    heads = symbols[order]
    low = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
    high = np.r_[low[1:], n]
    open_border[low] = False
    open_border[n] = False
    for _ in range(1, least):
        if not len(low):
            break
        size = high - low
        one = size == 1
        first, last = [last_to_first[low[one]]], [last_to_first[low[one]]]
        low, high, size = low[~one], high[~one], size[~one]
        if len(low):
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            first.append(last_to_first[at[preceding[at] < np.repeat(low, size)]])
            last.append(last_to_first[at[following[at] >= np.repeat(high, size)]])
        # intervals of one level are disjoint: sorted borders pair up
        low, high = np.sort(np.concatenate(first)), np.sort(np.concatenate(last)) + 1
        new = open_border[high]
        low, high = low[new], high[new]
        open_border[high] = False
    return open_border[:n]


def compare_strings(strings: list[bytes], units: Units) -> list[tuple[int, int, int]]:
    """``(string, start, end)``: ranges of window starts whose window occurs again among the strings."""
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths + 1)
    symbols = np.empty(int(ends[-1]), np.int32)
    sign = np.zeros(len(symbols), bool)
    sign[ends - 1] = True
    symbols[sign] = np.arange(len(strings))
    symbols[~sign] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int32) + len(strings)
    order = suffix_order(symbols)
    shares = long_common_prefixes(order, symbols, units.width)
    repeated = np.zeros(len(symbols) + 1, bool)
    repeated[order[shares]] = True
    repeated[order[np.flatnonzero(shares) - 1]] = True
    starts = np.flatnonzero(repeated[:-1] & ~np.r_[False, repeated[:-2]])
    stops = np.flatnonzero(repeated[:-1] & ~repeated[1:]) + 1
    string = np.searchsorted(ends, starts, "right")
    base = ends[string] - lengths[string] - 1
    return list(zip(string.tolist(), (starts - base).tolist(), (stops - base).tolist()))


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_units, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    Texts are UTF-8 bytes (null: none). Every byte inside a ``width``-byte string that also
    starts anywhere else in the corpus, the same text included, is removed; overlaps count,
    and no string spans two texts. Strings travel by their minimiser
    (:mod:`tessera.llm.repeats`); where they meet, the transform finds the repeated ones.
    Repeated rows are copies of each other. Texts shorter than ``width`` stay whole. Other
    columns are ignored; no rows in, no rows out.
    """
    return remove_repeats(docs, Units("byte", width, gram), compare_strings)

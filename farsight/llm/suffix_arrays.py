"""Suffix arrays of one shard: Larsson-Sadakane refinement, Kasai common prefixes, merging."""

from __future__ import annotations

import numpy as np

# Positions and ranks of a shard are packed into one sortable integer of 64 bits.
MAX_SYMBOLS = 1 << 20
_MASK = MAX_SYMBOLS - 1


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, place): the sorted suffixes, and its inverse.

    ``symbols`` are 0 to 256, the last one 0. Suffixes are sorted by four symbols, then every group
    that is still tied is refined by the rank of what follows, doubling the depth; settled suffixes
    are left alone.
    """
    n = len(symbols)
    if n > MAX_SYMBOLS:
        raise ValueError(f"a shard has at most {MAX_SYMBOLS} symbols")
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(4, np.int64)))
    first = padded[:n] << 27 | padded[1 : n + 1] << 18 | padded[2 : n + 2] << 9 | padded[3 : n + 3]
    packed = np.sort(first << 20 | np.arange(n))
    order, key = packed & _MASK, packed >> 20
    fresh = np.concatenate(([True], key[1:] != key[:-1]))[:n]
    rank = np.zeros(n + 1, np.int64)  # the first slot of a suffix's group, plus one; beyond the end 0
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    depth = 4
    while depth < 2 * n:
        slots = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))[:n]))
        if not len(slots):
            break
        at = order[slots]
        packed = np.sort((rank[at] - 1) << 41 | rank[np.minimum(at + depth, n)] << 20 | at)
        at, key = packed & _MASK, packed >> 20
        apart = np.concatenate(([True], key[1:] != key[:-1]))
        order[slots], fresh[slots] = at, apart
        rank[at] = slots[np.maximum.accumulate(np.where(apart, np.arange(len(slots)), 0))] + 1
        depth *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(symbols: np.ndarray, order: np.ndarray, place: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: int) -> np.ndarray:
    """Length of the prefix that each slot shares with the slot before, up to ``limit``.

    A prefix ends at symbol 0. Text positions are visited left to right and each keeps all but one
    symbol of its predecessor's prefix; the segments (``starts``, ``lengths``) advance side by side.
    """
    out = np.zeros(len(symbols), np.int64)
    text = np.concatenate((symbols, np.zeros(limit + 1, symbols.dtype)))
    shared = np.zeros(len(starts), np.int64)
    for step in range(int(lengths.max(initial=0))):
        lane = np.flatnonzero(lengths > step)
        i = starts[lane] + step
        slot = place[i]
        j = order[np.maximum(slot - 1, 0)]
        h = np.where(slot > 0, np.maximum(shared[lane] - 1, 0), 0)
        open_ = np.flatnonzero((slot > 0) & (h < limit))
        while len(open_):
            a, b = text[i[open_] + h[open_]], text[j[open_] + h[open_]]
            open_ = open_[(a == b) & (a != 0)]
            h[open_] += 1
            open_ = open_[h[open_] < limit]
        shared[lane] = h
        out[slot] = h
    return out


def window_classes(segments: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, class, slot) of the first ``windows[k]`` starts of each segment k.

    Starts of one class begin equal strings of ``length`` bytes; slots are in the strings' order.
    """
    lengths = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    symbols = raw.astype(np.int16) + 1
    symbols[ends - 1] = 0
    order, place = suffix_array(symbols)
    prefixes = common_prefixes(symbols, order, place, starts, lengths, length)
    classes = np.cumsum(prefixes < length)
    segment = np.repeat(np.arange(len(segments)), windows)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    slot = place[starts[segment] + offset]
    return segment, offset, classes[slot], slot


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Which strings of several sorted runs (strings, document, position) occur earlier in any run.

    Runs are merged one by one: a binary search finds the strings that are known already, the
    earlier place is kept, and new strings are inserted where the search ended.
    """
    known, doc, at = (x.copy() for x in runs[0])
    for strings, d, p in runs[1:]:
        where = np.searchsorted(known, strings)
        same = known[np.minimum(where, len(known) - 1)] == strings
        hit = where[same]
        earlier = (d[same] < doc[hit]) | ((d[same] == doc[hit]) & (p[same] < at[hit]))
        doc[hit[earlier]], at[hit[earlier]] = d[same][earlier], p[same][earlier]
        known, doc, at = (np.insert(x, where[~same], y[~same]) for x, y in ((known, strings), (doc, d), (at, p)))
    out = []
    for strings, d, p in runs:
        where = np.searchsorted(known, strings)
        out.append((doc[where] != d) | (at[where] != p))
    return out

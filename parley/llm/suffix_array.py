"""A suffix array by difference cover modulo 3 (Kärkkäinen and Sanders, 2003), in numpy, up to a wanted depth."""

from __future__ import annotations

import numpy as np


def _joined(columns: list[np.ndarray], tops: list[int]) -> np.ndarray:
    """One int64 key for each row, ordered as the rows are by their columns; tops: a bound over each column's values."""
    key, room = columns[0].astype(np.int64), tops[0] + 1
    for c, top in zip(columns[1:], tops[1:], strict=True):
        if room * (top + 1) >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            room = int(key.max(initial=0)) + 1
        key = key * (top + 1) + c
        room *= top + 1
    return key


def suffix_array(text: np.ndarray, depth: int, reach: int = 1) -> np.ndarray:
    """The order of text's suffixes by their first depth symbols at least; how ties beyond are ordered is left open.

    text: positive integers. reach: how many symbols of the first text one symbol stands for. Triples at the places that are 1 or 2
    modulo 3 are sorted and named; unless all names differ, or the names already tell the wanted depth, the order of these
    suffixes comes from the suffix array of the names. The other suffixes are sorted by their first symbol and the rank
    after it, and both orders are merged: a suffix's place is its place in its own order plus the number of smaller ones in the other.
    """
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:].tolist())), np.int64)
    top = int(text.max())
    t = np.zeros(n + 3, np.int64)
    t[:n] = text
    ones = np.arange(1, n + (n % 3 == 1), 3)  # a place beyond the end closes the first part where its last triple is full
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    key = _joined([t[sample], t[sample + 1], t[sample + 2]], [top] * 3)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(fresh)
    if not fresh.all() and reach * 3 < depth:
        order = suffix_array(names, depth, reach * 3)
    if len(ones) and ones[-1] >= n:
        order = order[sample[order] < n]
    sorted_sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted_sample] = np.arange(1, len(sorted_sample) + 1)
    size = len(sorted_sample) + 1

    zeros = np.arange(0, n, 3)
    by_one = _joined([t[zeros], rank[zeros + 1]], [top, size])
    o = np.argsort(by_one, kind="stable")
    zeros, by_one = zeros[o], by_one[o]
    is_one = sorted_sample % 3 == 1
    s1, s2 = sorted_sample[is_one], sorted_sample[~is_one]
    k1 = _joined([t[s1], rank[s1 + 1]], [top, size])
    both = _joined([np.concatenate([t[zeros], t[s2]]), np.concatenate([t[zeros + 1], t[s2 + 1]]), np.concatenate([rank[zeros + 2], rank[s2 + 2]])], [top, top, size])
    by_two, k2 = both[: len(zeros)], both[len(zeros) :]
    out = np.empty(n, np.int64)
    smaller = np.empty(len(sorted_sample), np.int64)
    smaller[is_one] = np.searchsorted(by_one, k1)
    smaller[~is_one] = np.searchsorted(by_two, k2)
    out[np.arange(len(sorted_sample)) + np.maximum.accumulate(smaller)] = sorted_sample
    taken = np.ones(n, bool)
    taken[np.arange(len(sorted_sample)) + np.maximum.accumulate(smaller)] = False
    out[taken] = zeros
    return out


def equal_neighbours(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order but the first: does it share its first length bytes with the one before? All have that many."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(max(len(order) - 1, 0), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        w = words[order + at]
        same &= w[1:] == w[:-1]
    return same

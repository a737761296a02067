"""Suffix arrays by induced sorting, and permuted common prefixes, of one byte string.

A suffix is smaller (S) or larger (L) than the one after it; an S suffix behind an L is leftmost
smaller (LMS). The order of the LMS suffixes induces that of all others: walking the buckets (first
bytes) upwards places every L suffix behind the one it stands in front of, walking them downwards
places the S suffixes. Both walks take a whole bucket at a step, so their cost is linear and they
run as array operations; a bucket is taken in several steps only where one byte follows itself.

LMS substrings are sorted by the same walks, from LMS suffixes in any order. Equal ones get the same
name, and if names repeat, the text of names is sorted in turn. Its alphabet is too large to walk
bucket by bucket, so there the names are doubled: names of pairs, of pairs of pairs, and so on.
"""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``data`` (bytes) in order; an end comes before any byte."""
    n = len(data)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    data = np.ascontiguousarray(data, dtype=np.uint8)
    small = _smaller(data)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    walk = _Walk(data, small)
    order = walk.induce(lms)
    if len(lms) < 2:
        return order
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    return walk.induce(_sort_lms(data, lms, order[is_lms[order]]))


def _smaller(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is not, as the end is smallest."""
    step = np.sign(np.diff(data.astype(np.int16)))
    n = len(data)
    # Equal bytes are as the first pair of unequal ones behind them.
    decided = np.where(step != 0, np.arange(n - 1), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return np.append(np.append(step, -1)[decided] > 0, False)


class _Walk:
    def __init__(self, data: np.ndarray, small: np.ndarray):
        self.data, self.small = data, small
        self.sizes = np.bincount(data, minlength=256)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.used = np.flatnonzero(self.sizes).tolist()

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes in the order that the LMS suffixes, in theirs, induce."""
        data, small = self.data, self.small
        first = data[lms]
        by_bucket = lms[np.argsort(first, kind="stable")]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=256))])
        order = np.zeros(len(data), dtype=np.int32)
        fill = self.starts.copy()
        last = len(data) - 1  # the end induces the last suffix, which is of type L
        order[fill[data[last]]] = last
        fill[data[last]] += 1
        for c in self.used:
            at = self.starts[c]
            while at < fill[c]:
                some = order[at : fill[c]]
                at = fill[c]
                self._place_up(order, fill, some)
            if bounds[c] < bounds[c + 1]:
                self._place_up(order, fill, by_bucket[bounds[c] : bounds[c + 1]])
        larger_end = fill
        fill = self.ends.copy()
        for c in reversed(self.used):
            at = self.ends[c]
            while at > fill[c]:
                some = order[fill[c] : at][::-1]
                at = fill[c]
                self._place_down(order, fill, some)
            if self.starts[c] < larger_end[c]:
                self._place_down(order, fill, order[self.starts[c] : larger_end[c]][::-1])
        return order

    def _place_up(self, order: np.ndarray, fill: np.ndarray, some: np.ndarray) -> None:
        before = some[some > 0] - 1
        before = before[~self.small[before]]
        if len(before):
            at, before, count = _dealt(self.data, before)
            order[fill[self.data[before]] + at] = before
            fill += count

    def _place_down(self, order: np.ndarray, fill: np.ndarray, some: np.ndarray) -> None:
        before = some[some > 0] - 1
        before = before[self.small[before]]
        if len(before):
            at, before, count = _dealt(self.data, before)
            order[fill[self.data[before]] - 1 - at] = before
            fill -= count


def _dealt(data: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes by first byte, the place of each among those of its byte, and their numbers."""
    byte = data[some]
    by_byte = np.argsort(byte, kind="stable")
    count = np.bincount(byte, minlength=256)
    at = np.arange(len(some)) - np.repeat(np.cumsum(count) - count, count)
    return at, some[by_byte], count


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number, with zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _sort_lms(data: np.ndarray, lms: np.ndarray, by_substring: np.ndarray) -> np.ndarray:
    """LMS suffixes in order, from the order of their substrings."""
    n = len(data)
    size = np.zeros(n, dtype=np.int32)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = n - lms[-1] + 1  # holds the end, so it equals no other
    lanes = _lanes(data)
    a, b = by_substring[:-1], by_substring[1:]
    same = (size[a] == size[b]) & (a != lms[-1]) & (b != lms[-1])
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        left = size[a[open_]] - k
        equal = ((lanes[a[open_] + k] ^ lanes[b[open_] + k]) & _MASKS[np.minimum(left, 8)]) == 0
        same[open_[~equal]] = False
        k += 8
        open_ = open_[equal & (left > 8)]
    place = np.zeros(n, dtype=np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    return lms[_sort_names(place[by_substring], np.append(True, ~same))]


def _sort_names(order: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The suffixes of a text of names in order, by doubling; an end is smallest.

    ``order`` are the places of the text by name, and ``opens`` tells where a new name begins. A
    name is one more than where it begins; only places whose name is not theirs alone are sorted
    again.
    """
    m, width = len(order), 1
    name = np.empty(m, dtype=np.int64)
    name[order] = np.maximum.accumulate(np.where(opens, np.arange(m), 0)) + 1
    while True:
        shared = np.flatnonzero(~(opens & np.append(opens[1:], True)))
        if not len(shared):
            return order
        some = order[shared]
        behind = np.zeros(len(some), dtype=np.int64)
        inside = some < m - width
        behind[inside] = name[some[inside] + width]
        pair = name[some] * np.int64(m + 1) + behind
        by_pair = np.argsort(pair)
        some, pair = some[by_pair], pair[by_pair]
        order[shared] = some
        opens[shared] = fresh = np.append(True, pair[1:] != pair[:-1])
        name[some] = np.maximum.accumulate(np.where(fresh, shared, 0)) + 1
        width *= 2


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By position: the length of the common prefix of a suffix and the one before it in order.

    Along the text such a length falls by one at most, and by exactly one wherever the suffixes one
    byte further left are neighbours too. Only the others are compared, all at once, eight bytes
    at a time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int32)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    follows = np.zeros(n, dtype=bool)
    inner = (at > 0) & (before > 0)
    follows[inner] = data[at[inner] - 1] == data[before[inner] - 1]
    compared = np.flatnonzero(~follows & (before >= 0))
    length = np.zeros(n, dtype=np.int32)
    lanes = _lanes(data)
    open_, k = compared, 0
    while len(open_):
        other = before[open_]
        room = n - np.maximum(open_, other) - k
        differ = (lanes[np.minimum(open_ + k, n)] ^ lanes[np.minimum(other + k, n)]) & _MASKS[np.clip(room, 0, 8)]
        equal = differ == 0
        low = differ[~equal]
        # The lowest set bit tells the first byte that differs.
        bit = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int32)
        length[open_[~equal]] = k + bit // 8
        ended = equal & (room <= 8)
        length[open_[ended]] = k + np.maximum(room[ended], 0)
        open_ = open_[equal & ~ended]
        k += 8
    source = np.maximum.accumulate(np.where(follows, 0, at))
    return np.maximum(length[source] - (at - source), 0).astype(np.int32)

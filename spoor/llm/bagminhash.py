"""BagMinHash: signatures that agree in a place with the weighted Jaccard similarity as chance.

The bag of a text holds its shingles with their numbers of occurrence. Every shingle has its own
fixed set of random points over the plane of weight and time, ``size`` of them on average per unit
of weight and time, each with a random place in the signature. A place takes the earliest point
whose weight coordinate lies within the shingle's weight, so two texts agree in a place if the
earliest point of either bag lies in both.

The weight axis is cut at 1, 2, 4, 8, ...; each strip has a Poisson process of its own. A strip
within the weight takes all its points; in the strip that the weight ends in, a point's coordinate
is refined by halving, bit by bit, until it is known on which side of the weight it lies. Points
come in order of time, and only those before a horizon are drawn, after which all places but a few
are taken; the texts with a place left are drawn again with a longer horizon.
"""

from __future__ import annotations

import numpy as np

from spoor.llm.words import Words, mix, mix_one, ngram_hashes

_STRIP, _NTH, _POINT, _BIT = (mix_one(k) for k in (101, 102, 103, 104))
BURST = 8
STRETCH = 8192


def bags(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and number of occurrences, sorted by text and shingle.

    A text of fewer words than ``n``, but not none, has one shingle of all of them.
    """
    value, at = ngram_hashes(words, n)
    text = np.searchsorted(words.first, at, side="right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        ones = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = words.counts[short] > k
            ones[has] = mix(ones[has] * np.uint64(3) + words.hash[words.first[:-1][short[has]] + k])
        value, text = np.concatenate([value, ones]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    return text[starts], value[starts], np.diff(np.append(starts, len(value)))


def _points(text, key, weight, horizon, size):
    """Accepted points before the horizon of their text: text, place, time, identity."""
    found = []
    strip = 0
    own = np.arange(len(key))
    while len(own):
        width = 1.0 if strip == 0 else float(1 << (strip - 1))
        seed = mix(key[own] ^ (_STRIP + np.uint64(strip)))
        # Most shingles of a long text have no point before the horizon: one draw each finds out.
        streams, time, drawn, burst = own, np.zeros(len(own)), 0, 1
        while len(streams):
            nth = _NTH + np.arange(drawn, drawn + burst, dtype=np.uint64)
            points = mix(seed[:, None] + nth[None, :] * _POINT)
            chance = ((points >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53
            times = time[:, None] + np.cumsum(-np.log(chance) / (size * width), axis=1)
            limit = horizon[text[streams]]
            row, col = np.nonzero(times <= limit[:, None])
            if len(row):
                at, point = streams[row], mix(points[row, col] ^ _POINT)
                inside = _inside(weight[at], point, strip)
                found.append((text[at][inside], (point % np.uint64(size)).astype(np.int64)[inside], times[row, col][inside], point[inside]))
            go_on = times[:, -1] <= limit
            streams, seed, time = streams[go_on], seed[go_on], times[go_on, -1]
            drawn, burst = drawn + burst, BURST
        strip += 1
        own = own[weight[own] > (1 << (strip - 1))]
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4


def _inside(weight: np.ndarray, point: np.ndarray, strip: int) -> np.ndarray:
    """Whether the point's weight coordinate, a number in the strip, lies below the weight."""
    if strip == 0:
        return np.ones(len(point), dtype=bool)
    low, high = np.full(len(point), 1 << (strip - 1)), np.full(len(point), 1 << strip)
    for level in range(strip - 1):
        open_ = (low < weight) & (high > weight)
        if not open_.any():
            break
        middle = (low + high) // 2
        upper = (mix(point ^ (_BIT + np.uint64(level))) & np.uint64(1)).astype(bool)
        low = np.where(open_ & upper, middle, low)
        high = np.where(open_ & ~upper, middle, high)
    return high <= weight


def signatures(text: np.ndarray, key: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """(texts, size) identities of the earliest points; texts without shingles keep zeros."""
    out = np.zeros((texts, size), dtype=np.uint64)
    total = np.bincount(text, weights=weight, minlength=texts)
    reach = np.log(size) + 4.0
    todo = total > 0
    while todo.any():
        mine = todo[text]
        horizon = np.where(todo, reach / np.maximum(total, 1.0), 0.0)
        who, place, time, point = _points(text[mine], key[mine], weight[mine], horizon, size)
        slot = who * size + place
        best = np.full(texts * size, np.inf)
        np.minimum.at(best, slot, time)
        first = time == best[slot]
        flat = out.reshape(-1)
        flat[slot[first]] = point[first]
        filled = np.isfinite(best).reshape(texts, size).all(axis=1)
        todo &= ~filled
        reach *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` places."""
    value = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(signature), axis=0)
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for k in range(rows):
        value = mix(value * np.uint64(3) + parts[:, :, k])
    return value


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (sorted shingles, occurrences)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - shared
    return float(shared / whole) if whole else 0.0


def sizes(text: np.ndarray, texts: int) -> np.ndarray:
    """Where each text's shingles begin; one more entry than texts."""
    return np.searchsorted(text, np.arange(texts + 1))


def overlaps(
    text: np.ndarray, key: np.ndarray, weight: np.ndarray, texts: int, one: np.ndarray, two: np.ndarray
) -> np.ndarray:
    """Weighted Jaccard of every text in ``one`` with every text in ``two``.

    The k-th occurrence of a shingle is an item of its own, so the overlap of two bags is the
    number of items they share: a product of two 0/1 matrices, taken in stretches of items.
    """
    total = np.bincount(text, weights=weight, minlength=texts)
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    items, owner = mix(np.repeat(key, weight) + nth.astype(np.uint64) * _NTH), np.repeat(text, weight)
    _, item, seen = np.unique(items, return_inverse=True, return_counts=True)
    shared = seen[item] > 1
    item, owner = np.unique(item[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    row_one, row_two = np.full(texts, -1), np.full(texts, -1)
    row_one[one], row_two[two] = np.arange(len(one)), np.arange(len(two))
    common = np.zeros((len(one), len(two)), dtype=np.float32)
    for begin in range(0, int(item.max(initial=-1)) + 1, STRETCH):
        a, b = np.searchsorted(item, [begin, begin + STRETCH])
        sides = []
        for rows, n in ((row_one, len(one)), (row_two, len(two))):
            row = rows[owner[a:b]]
            matrix = np.zeros((n, STRETCH), dtype=np.float32)
            matrix[row[row >= 0], item[a:b][row >= 0] - begin] = 1
            sides.append(matrix)
        common += sides[0] @ sides[1].T
    whole = total[one][:, None] + total[two][None, :] - common
    return np.where(whole > 0, common / np.maximum(whole, 1), 0.0)

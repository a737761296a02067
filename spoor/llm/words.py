"""Words, their hashes and n-grams of many texts at once, inside an Arrow batch.

A word is a run of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. UTF-8 writes
every non-ASCII character in bytes from 0x80 on, so words are runs of bytes and no text needs
decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
# A longer run is hashed by itself, so that one long word does not add passes for all.
LONG_WORD = 256

_byte = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
_IS_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MUL1 = np.uint64(0xBF58476D1CE4E5B9)
_MUL2 = np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def mix_one(x: int) -> np.uint64:
    return mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]


@dataclass(frozen=True)
class Words:
    data: np.ndarray  # lower-cased bytes of all texts
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # words before each text; one more entry than texts
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry than texts); null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(texts: pa.Array) -> Words:
    data, bounds = text_bytes(texts)
    data = _LOWER[data]
    is_word = _IS_WORD[data]
    opens = is_word.copy()
    opens[1:] &= ~is_word[:-1]
    closes = is_word.copy()
    closes[:-1] &= ~is_word[1:]
    # Two texts lie side by side in the buffer; a word ends where its text ends.
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = is_word[inner]
    closes[inner - 1] = is_word[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, start, end, np.searchsorted(start, bounds), _hash_words(data, start, end))


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight bytes at a step; bytes past a word's end are masked."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix(size.astype(np.uint64))
    for k in range(0, int(min(size.max(initial=0), LONG_WORD)), 8):
        at = np.flatnonzero(size > k) if k else slice(None)
        lane = lanes[start[at] + k] & _MASKS[np.minimum(size[at] - k, 8)]
        out[at] = (out[at] ^ lane) * _MUL1
        out[at] ^= out[at] >> np.uint64(29)
    for i in np.flatnonzero(size > LONG_WORD):
        rest = data[start[i] + LONG_WORD : end[i]]
        pad = np.zeros(-(-len(rest) // 8) * 8, dtype=np.uint8)
        pad[: len(rest)] = rest
        eights = pad.view("<u8")
        ranks = np.arange(1, len(eights) + 1, dtype=np.uint64) * _STEP
        out[i] ^= np.bitwise_xor.reduce(mix(eights ^ mix(ranks)))
    return mix(out)


def ngram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within one text, and the position of its first word."""
    total = len(words.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = words.owner
    at = np.flatnonzero(owner[: total - n + 1] == owner[n - 1 :])
    value = np.full(len(at), mix_one(n), dtype=np.uint64)
    for j in range(n):
        value = mix(value + words.hash[at + j] * np.uint64(2 * j + 1))
    return value, at


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text is alone in its slice."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(total):
        before = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop

"""Benchmark decontamination: Wu-Manber search for the word windows of test items.

The alphabet is the words (their 64-bit hashes) instead of characters. For all windows of one
length L a shift table, indexed by the hash of a block of B words, tells how far the search may
move on when a block is seen at the window's end: L - B + 1 words when no window holds the block,
0 when some window ends in it. Only at shift 0 the suffix bucket is opened, the windows' first
blocks are compared, then all their words, and last the bytes of the text itself.

The search of one Arrow batch moves all its cursors in step: each text is cut into stretches of
end positions, each with a cursor of its own, so a long text takes no longer than a short one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import free_name, with_columns_last
from spoor.llm.words import Words, chunks, mix, mix_one, words_of

WINDOW = 13
BLOCK_WORDS = 3
STRETCH = 256
# Test text searched for in one pass over the documents; more is searched for in several passes.
PASS_BYTES = 8 << 20
TABLE_BITS = 18
SPANS = "array<struct<start:bigint,end:bigint,item:string>>"


@dataclass(frozen=True)
class Patterns:
    """The distinct windows of one length with the tables of the search."""

    length: int
    block: int
    words: np.ndarray  # (windows, length) word hashes
    head: np.ndarray  # hash of each window's first block
    suffixes: np.ndarray  # sorted hash of each window's last block
    by_suffix: np.ndarray  # windows in that order
    shift: np.ndarray
    items: list[list[str]]  # of each window


def _blocks(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position."""
    value = np.full(len(at), mix_one(size), dtype=np.uint64)
    for j in range(size):
        value = mix(value + hashes[at + j] * np.uint64(2 * j + 1))
    return value


def _slot(block: np.ndarray) -> np.ndarray:
    return (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def build_patterns(items: Sequence[tuple[object, str | None]], window: int = WINDOW):
    """Patterns by length, and the bytes of every word that they use."""
    items = [(str(i), t) for i, t in items if i is not None]
    words = words_of(pa.array([t for _, t in items], type=pa.large_string()))
    spelled = {int(h): words.bytes_of(i) for i, h in enumerate(words.hash)}
    groups: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for k, (name, _) in enumerate(items):
        own = words.hash[words.first[k] : words.first[k + 1]]
        length = min(len(own), window)
        for i in range(len(own) - length + 1) if length else ():
            at = groups[length][own[i : i + length].tobytes()]
            if name not in at:
                at.append(name)
    found = []
    for length, named in sorted(groups.items()):
        table = np.frombuffer(b"".join(named), dtype=np.uint64).reshape(-1, length)
        block = min(BLOCK_WORDS, length)
        flat, starts = table.ravel(), np.arange(len(table)) * length
        shift = np.full(1 << TABLE_BITS, length - block + 1, dtype=np.int32)
        for j in range(length - block + 1):
            np.minimum.at(shift, _slot(_blocks(flat, starts + j, block)), length - block - j)
        last = _blocks(flat, starts + length - block, block)
        order = np.argsort(last, kind="stable")
        found.append(
            Patterns(length, block, table, _blocks(flat, starts, block), last[order], order, shift, list(named.values()))
        )
    return found, spelled


def search(words: Words, patterns: Patterns, spelled: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence."""
    length, block = patterns.length, patterns.block
    counts = words.counts
    # Cursors stand on window starts; a text of n words has n - length + 1 of them.
    room = np.maximum(counts - length + 1, 0)
    pieces = -(-room // STRETCH)
    text = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cursor = words.first[:-1][text] + nth * STRETCH
    stop = np.minimum(cursor + STRETCH, words.first[:-1][text] + room[text])
    at: list[np.ndarray] = []
    which: list[np.ndarray] = []
    while len(cursor):
        tail = _blocks(words.hash, cursor + length - block, block)
        shift = patterns.shift[_slot(tail)]
        ends = np.flatnonzero(shift == 0)
        if len(ends):
            low = np.searchsorted(patterns.suffixes, tail[ends], side="left")
            size = np.searchsorted(patterns.suffixes, tail[ends], side="right") - low
            place = np.repeat(cursor[ends], size)
            inside = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
            window = patterns.by_suffix[np.repeat(low, size) + inside]
            same = _blocks(words.hash, place, block) == patterns.head[window]
            place, window = place[same], window[same]
            if len(place):
                same = (words.hash[place[:, None] + np.arange(length)] == patterns.words[window]).all(axis=1)
                at.append(place[same])
                which.append(window[same])
        cursor = cursor + np.maximum(shift, 1)
        open_ = cursor < stop
        cursor, stop = cursor[open_], stop[open_]
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, window = np.concatenate(at), np.concatenate(which)
    used = np.unique(place[:, None] + np.arange(length))
    wrong = [i for i in used if words.bytes_of(i) != spelled[int(words.hash[i])]]
    if wrong:
        good = ~np.isin(place[:, None] + np.arange(length), wrong).any(axis=1)
        place, window = place[good], window[good]
    return place, window


def _spans_of(words: Words, groups: list[Patterns], spelled: dict[int, bytes]) -> list[list[dict]]:
    """Per text the occurrences, those of one item that touch or overlap joined to one span."""
    out: list[list[dict]] = [[] for _ in words.counts]
    hits: dict[tuple[int, str], list[tuple[int, int]]] = defaultdict(list)
    for patterns in groups:
        place, window = search(words, patterns, spelled)
        text = np.searchsorted(words.first, place, side="right") - 1
        for t, p, w in zip(text.tolist(), (place - words.first[text]).tolist(), window.tolist()):
            for item in patterns.items[w]:
                hits[t, item].append((p, p + patterns.length))
    for (t, item), found in sorted(hits.items()):
        found.sort()
        start, end = found[0]
        for a, b in found[1:]:
            if a > end:
                out[t].append({"start": start, "end": end, "item": item})
                start, end = a, b
            end = max(end, b)
        out[t].append({"start": start, "end": end, "item": item})
    return out


def find_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
    outputs: tuple[str, str] = ("n_words", "spans"),
) -> DataFrame:
    """Every document with its number of words and its ``spans`` (the names are ``outputs``): word ranges in which an item's windows occur.

    ``start`` is the first word (from 0), ``end`` one past the last. Windows are ``window``
    consecutive item words; an item of fewer words, but not none, is one window. Null texts have no
    words; an item without an id is not searched for, as it could not be named. Rows are never
    joined or grouped, so repeated rows and ids stay as they are. Columns of the input that
    have a name of ``outputs`` give way.

    Test items are a stated set: they are read to the driver in blocks of about ``pass_bytes``,
    each searched for by a column of its own in one pass over the batches of the same scan. Texts
    go to Python, and only what is found comes back.
    """
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).filter(
        F.col("i").isNotNull() & F.col("t").isNotNull()
    ).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    found = []
    for k in range(passes):
        mine = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).sort("i", "t").collect()
        found.append(_search_column(F.col(f"`{text}`"), [(r.i, r.t) for r in mine], window))
    spans = found[0]["spans"] if passes == 1 else F.concat(*[one["spans"] for one in found])
    return with_columns_last(docs, {outputs[0]: found[0]["n_words"], outputs[1]: spans})


def _search_column(text: Column, items: list[tuple[str, str]], window: int) -> Column:
    """A struct of the text's number of words and of the items' spans in it."""

    @F.arrow_udf(f"struct<n_words:bigint,spans:{SPANS}>")
    def search_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        groups, spelled = build_patterns(items, window)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())]))
        for texts in batches:
            counts, spans = [], []
            for part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
                words = words_of(part.column(0))
                counts.append(words.counts.astype(np.int64))
                spans += _spans_of(words, groups, spelled)
            n_words = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))
            yield pa.StructArray.from_arrays([n_words, pa.array(spans, kind)], names=["n_words", "spans"])
            del texts
            pa.default_memory_pool().release_unused()

    return search_texts(text)


def hit_words(spans: Column) -> Column:
    """Words inside any of the spans."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.lit(0).cast("long")
    # Each span adds what lies beyond the furthest end so far.
    return F.aggregate(
        ordered,
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), zero)).alias("n"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Some word is hit, and the hit words are a twentieth of all words or more."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def item_ids(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["item"])))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns; null texts stay."""
    outputs = (free_name(docs.columns, "n_words"), free_name(docs.columns, "spans"))
    found = find_spans(docs, benchmark, text, outputs=outputs)
    return found.filter(~is_contaminated(hit_words(F.col(outputs[1])), F.col(outputs[0]))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )

"""Repeated passages: bytes covered by a string of ``length`` bytes that also starts earlier.

1. Every window of ``length`` bytes has an anchor, the least of its grams by hash. Neighbouring windows
   with the same anchor are one context: the bytes they cover. Equal windows have equal anchors, so
   contexts are dealt out by anchor, at first as hashes only. Of equal contexts all but the earliest
   are repeats as a whole; a context that is alone with its anchor has none. What is left are different
   contexts of one anchor: the borders of copies and of shared passages.
2. Their bytes are read from the texts and dealt out by anchor again. A task takes them in shards of
   bounded size. A shard is one byte string, whose suffix array is built by induced sorting; its
   permuted common prefixes tell which neighbours in order share ``length`` bytes. Such windows are one
   class, and all but its earliest are repeats.
3. Repeats go back to their documents, where the bytes they cover are joined to spans.

Equal contexts are settled in every batch before they are sent. Contexts of an anchor that a sample
shows to be frequent, or that turns out larger than a shard, are judged by aggregation: first whole
contexts, then the windows of what is left, by 128-bit hash. No group is held by a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.common import free_prefix, store
from spoor.llm.suffix_arrays import permuted_prefixes, suffix_array
from spoor.llm.words import chunks, mix, mix_one, text_bytes

LENGTH = 100
GRAM = 24
# Longer texts are worked on in pieces of so many windows; places in a piece take POSITION_BITS.
PIECE = 4 << 20
POSITION_BITS = 24
# A shard's contexts; an anchor with more is judged by aggregation.
SHARD_BYTES = 2 << 20
# Anchors in more than this share of about so many sampled documents are frequent.
SAMPLE_DOCS = 10_000
FREQUENT = 1 / 500

_LAST_ID = (1 << 63) - 1
_SEPARATOR = 255  # no byte of UTF-8
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
# A task holds so many contexts' hashes at once; an anchor with more is settled by aggregation.
SHARD_HASHES = 500_000
_PLACE = "doc bigint, row bigint, start bigint, n bigint"
_HASHED = f"key bigint, hash bigint, digest bigint, frequent boolean, {_PLACE}"
_SETTLED = f"hash bigint, digest bigint, frequent boolean, {_PLACE}"
_CUT = f"hash bigint, frequent boolean, {_PLACE}, context binary"
_FOUND = f"{_PLACE}, context binary"
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_COVER = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(_SPAN)),
    ]
)


def _gram_hashes(data: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of the ``size`` bytes from each position that has so many."""
    many = max(0, len(data) - size + 1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    value = np.full(many, mix_one(seed), dtype=np.uint64)
    for k in range(0, size, 8):
        lane = lanes[k : k + many]
        if size - k < 8:
            lane = lane & _MASKS[size - k]
        value += lane * (mix_one(seed + 1 + k) | np.uint64(1))
        value ^= value >> np.uint64(31)
    return mix(value)


def _sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row: of the rest of its block and the start of the next."""
    many = len(value) - width + 1
    full = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(value)] = value
    blocks = full.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:many], head[width - 1 : width - 1 + many])


def _gram_size(length: int) -> int:
    return max(1, min(GRAM, length // 4))


def _contexts(data: np.ndarray, bounds: np.ndarray, length: int):
    """Per context of texts side by side: its first window, its number of windows, the anchor's hash.

    Also the hashes of all grams.
    """
    size = _gram_size(length)
    grams = _gram_hashes(data, size)
    windows = len(data) - length + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), grams
    places = np.uint64((1 << POSITION_BITS) - 1)
    ranked = (grams & ~places) | np.arange(len(grams), dtype=np.uint64)  # of equal ones the first
    anchor = (_sliding_least(ranked, length - size + 1) & places).astype(np.int64)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    holds = np.diff(bounds) >= length
    inside[bounds[:-1][holds]] += 1
    inside[bounds[1:][holds] - length + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8)[:windows].astype(bool)
    opens = inside.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes) + 1 - first, grams[anchor[first]], grams


def _digests(grams: np.ndarray, size: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of byte ranges from the hashes of their grams, which cover them."""
    value = mix(length.astype(np.uint64))
    for k in range(0, int(length.max(initial=0)), size):
        at = np.flatnonzero(length > k)
        gram = grams[start[at] + np.minimum(k, length[at] - size)]
        value[at] = mix(value[at] * np.uint64(0x9E3779B97F4A7C15) + gram)
    return value


def _settle(key: list[np.ndarray], doc, row, start) -> tuple[np.ndarray, np.ndarray]:
    """Of equal strings: which to go on with, and which are repeats.

    Repeats are those of a later document and those that start later in their own row. A repeated
    row's twins are neither: they are the same place.
    """
    if not len(doc):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort([start, row, doc, *key[::-1]])
    new_key = np.zeros(len(order), dtype=bool)
    for k in key:
        sorted_ = k[order]
        new_key[1:] |= sorted_[1:] != sorted_[:-1]
    new_key[0] = True
    d, r, s = doc[order], row[order], start[order]
    new_row = new_key.copy()
    new_row[1:] |= (d[1:] != d[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(order))
    key_first = np.maximum.accumulate(np.where(new_key, at, 0))
    row_first = np.maximum.accumulate(np.where(new_row, at, 0))
    later = (d > d[key_first]) | (s > s[row_first])
    kept = np.zeros(len(order), dtype=bool)
    repeated = np.zeros(len(order), dtype=bool)
    kept[order] = new_row & ~later
    repeated[order] = later
    return kept, repeated


def _runs(doc, row, start, n):
    """Stretches of windows, those that touch or overlap within a row joined."""
    if not len(doc):
        return doc, row, start, n
    order = np.lexsort([start, row, doc])
    doc, row, start, end = doc[order], row[order], start[order], (start + n)[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    return doc[first], row[first], start[first], np.maximum.reduceat(end, first) - start[first]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, gap: int = 0):
    """Byte ranges side by side, each followed by ``gap`` separators, and where each begins."""
    begin = np.cumsum(size + gap) - (size + gap)
    out = np.full(int((size + gap).sum()), _SEPARATOR, dtype=np.uint8)
    shift = np.repeat(start - begin, size)
    at = np.arange(len(shift)) + np.repeat(begin - (np.cumsum(size) - size), size)
    out[at] = data[at + shift]
    return out, begin


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _stretches(doc, row, start, n, fields: list[pa.Field]) -> pa.RecordBatch:
    """Stretches of repeated windows as rows whose other fields are null."""
    found = dict(zip(("doc", "row", "start", "n"), _runs(doc, row, start, n)))
    many = len(found["doc"])
    columns = [pa.array(found[f.name].astype(np.int64)) if f.name in found else pa.nulls(many, f.type) for f in fields]
    return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])


_PLACES = [pa.field(c, pa.int64()) for c in ("doc", "row", "start", "n")]
_HASHES = [pa.field("hash", pa.int64()), pa.field("digest", pa.int64()), pa.field("frequent", pa.bool_())]
_FOUND_FIELDS = [*_PLACES, pa.field("context", pa.binary())]


def _pieces(texts: pa.Array, length: int):
    """Texts side by side as bytes, with bounds, the text of each and where it begins in its text."""
    data, bounds = text_bytes(texts)
    if len(data) <= PIECE:
        yield data, bounds, np.arange(len(texts)), np.zeros(len(texts), np.int64)
        return
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for s in range(a, max(a + 1, b - length + 1), PIECE):
            end = min(b, s + PIECE + length - 1)
            yield data[s:end], np.array([0, end - s]), np.array([i]), np.array([s - a])


def _hashed(docs: DataFrame, length: int, frequent: list[int]) -> DataFrame:
    """The contexts of all texts (doc, row, text), and stretches that are repeats already (no hash)."""
    size = _gram_size(length)
    names = [part.split()[0] for part in _HASHED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.sort(np.array(frequent, dtype=np.int64).view(np.uint64))
        for batch in batches:
            for part in chunks(batch, "text"):
                docs_, rows = (part.column(i).to_numpy().astype(np.int64) for i in (0, 1))
                for data, bounds, text, base in _pieces(part.column(2), length):
                    first, n, anchor, grams = _contexts(data, bounds, length)
                    if not len(first):
                        continue
                    own = np.searchsorted(bounds, first, side="right") - 1
                    doc, row, start = docs_[text[own]], rows[text[own]], first - bounds[own] + base[own]
                    digest = _digests(grams, size, first, n + length - 1)
                    kept, repeated = _settle([anchor, digest], doc, row, start)
                    gone = _stretches(doc[repeated], row[repeated], start[repeated], n[repeated], _HASHES + _PLACES)
                    spread = mix(gone.column(3).to_numpy().view(np.uint64) + gone.column(5).to_numpy().view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), *gone.columns], names=names)
                    at = np.flatnonzero(kept)
                    hash_, is_often = anchor[at], np.zeros(len(at), bool)
                    if len(often):
                        is_often = often[np.minimum(np.searchsorted(often, hash_), len(often) - 1)] == hash_
                    # Equal contexts meet either way; those of a frequent anchor do not all go to one task.
                    key = np.where(is_often, mix(hash_ ^ digest[at]), hash_)
                    columns = [key.view(np.int64), hash_.view(np.int64), digest[at].view(np.int64), is_often]
                    columns += [c[at].astype(np.int64) for c in (doc, row, start, n)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            del batch
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, _HASHED)


def _groups(batches: Iterator[pa.RecordBatch], most: int, size) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows in order of their first column: several whole groups together, and whether they are whole.

    A group whose ``size`` is above ``most`` comes in parts instead.
    """
    held, too_large = None, None
    for batch in batches:
        if too_large is not None:
            more = int(np.searchsorted(batch.column(0).to_numpy(), too_large, side="right"))
            yield batch.slice(0, more), False
            batch = batch.slice(more)
        held = batch if held is None else pa.concat_batches([held, batch])
        if not held.num_rows or size(held) < most:
            continue
        key = held.column(0).to_numpy()
        cut_at = int(np.searchsorted(key, key[-1], side="left"))
        if cut_at:
            yield held.slice(0, cut_at), True
            held = held.slice(cut_at)
        else:
            too_large = key[-1]
            yield held, False
            held = None
    if held is not None and held.num_rows:
        yield held, True


def _settle_hashes(hashed: DataFrame, most: int) -> DataFrame:
    """Stretches (no hash), contexts whose bytes have to be read (no digest), and those yet to settle."""
    names = [part.split()[0] for part in _SETTLED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, whole in _groups(batches, most, lambda b: b.num_rows):
            known = pc.is_null(group.column(1)) if whole else None
            yield group.filter(known).select(names) if whole else group.select(names)
            if not whole:
                continue
            group = group.filter(pc.invert(known))
            key, hash_, digest = (group.column(i).to_numpy() for i in range(3))
            often = group.column(3).to_numpy(zero_copy_only=False)
            place = [group.column(i).to_numpy() for i in range(4, 8)]
            kept, repeated = _settle([hash_, digest], *place[:3])
            yield _stretches(*[c[repeated] for c in place], _HASHES + _PLACES)
            at = np.flatnonzero(kept)
            alone = np.ones(len(at), bool)
            alone[_not_alone(key[at])] = False
            at = at[~alone | often[at]]
            columns = [pa.array(hash_[at]), pa.nulls(len(at), pa.int64()), pa.array(often[at]), *[pa.array(c[at]) for c in place]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return hashed.repartition("key").sortWithinPartitions("key").mapInArrow(run, _SETTLED)


def _cut(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """The bytes of contexts (doc, row, start, n, hash, frequent), read from the texts."""
    wanted = open_.groupBy("doc", "row").agg(F.collect_list(F.struct("hash", "frequent", "start", "n")).alias("wanted"))
    found = docs.join(wanted, ["doc", "row"]).select("doc", "row", "wanted", "text")
    names = [part.split()[0] for part in _CUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, bounds = text_bytes(part.column(3))
                listed = part.column(2)
                many = pc.list_value_length(listed).to_numpy().astype(np.int64)
                text = np.repeat(np.arange(part.num_rows), many)
                hash_, often, start, n = (listed.flatten().field(i) for i in range(4))
                size = n.to_numpy() + length - 1
                held, _ = _gather(data, bounds[text] + start.to_numpy(), size)
                own = [pa.array(part.column(i).to_numpy()[text]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([hash_, often, *own, start, n, _binary(held, size)], names=names)
            del batch
            pa.default_memory_pool().release_unused()

    return found.mapInArrow(run, _CUT)


def _frequent(docs: DataFrame, length: int) -> list[int]:
    """Anchors in many documents of a sample; at most 500 per anchor of a mean document."""
    many = docs.count()
    bits = 40
    share = min(1.0, SAMPLE_DOCS / max(many, 1))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc", "row"), F.lit(1 << bits)) < int(share * (1 << bits))
    sample = docs.filter(drawn) if share < 1 else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                seen = []
                for data, bounds, text, _ in _pieces(part.column(2), length):
                    first, _, anchor, _ = _contexts(data, bounds, length)
                    own = text[np.searchsorted(bounds, first, side="right") - 1]
                    both = np.unique(np.stack([own.astype(np.uint64), anchor]), axis=1) if len(first) else np.zeros((2, 0))
                    seen.append(both[1].astype(np.uint64))
                hash_, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hash_.view(np.int64)), pa.array(n)], names=["hash", "n"])

    counted = sample.mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    least = max(3, FREQUENT * min(many, SAMPLE_DOCS))
    return [r["hash"] for r in counted.filter(F.col("n") > least).select("hash").collect()]


def _meet(cut: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Stretches of repeated windows, and the contexts that aggregation has to judge."""
    names = [f.name for f in _FOUND_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A frequent anchor's contexts are dealt out by another key than its hash, and judged elsewhere.
        rare = []

        def aside() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                often = batch.column(2)
                if pc.any(often).as_py():
                    rare.append(batch.filter(often).select(names))
                    batch = batch.filter(pc.invert(often))
                yield batch

        for group, whole in _groups(aside(), shard_bytes, lambda b: b.column(7).nbytes):
            while rare:
                yield rare.pop()
            yield _judge(group, length) if whole else group.select(names)
        yield from rare

    key = F.when(F.col("frequent"), F.xxhash64("doc", "row", "start")).otherwise(F.col("hash"))
    keyed = cut.select(key.alias("key"), "*")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def _judge(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The repeated windows of a shard, which has all contexts of its anchors."""
    hash_, doc, row, start, n = (batch.column(i).to_numpy() for i in (1, 3, 4, 5, 6))
    data, bounds = text_bytes(batch.column(7).cast(pa.large_binary()).view(pa.large_string()))
    first, found = bounds[:-1], []
    if len(hash_):
        text, first = _gather(data, first, n + length - 1, gap=1)
        order = suffix_array(text)
        shared = permuted_prefixes(text, order)
        class_ = np.empty(len(text), dtype=np.int64)
        class_[order] = np.cumsum(shared[order] < length)
        context = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
        class_ = class_[first[context] + nth]
        several = np.flatnonzero(np.bincount(class_)[class_] > 1)
        class_, context, nth = class_[several], context[several], nth[several]
        doc, row, start = doc[context], row[context], start[context] + nth
        _, repeated = _settle([class_], doc, row, start)
        found = [doc[repeated], row[repeated], start[repeated], np.ones(repeated.sum(), np.int64)]
    return _stretches(*(found or [np.zeros(0, np.int64)] * 4), _FOUND_FIELDS)


def _not_alone(sorted_: np.ndarray) -> np.ndarray:
    """Places whose value a neighbour has too."""
    same = np.concatenate([[False], sorted_[1:] == sorted_[:-1], [False]])
    return np.flatnonzero(same[1:] | same[:-1])


def _judge_by_aggregation(contexts: DataFrame, length: int) -> DataFrame:
    """Stretches of repeated windows among contexts of frequent anchors."""
    keyed = contexts.withColumn("key", F.unhex(F.md5("context")))
    judged = _settle_rows(keyed, ["key"])
    whole = judged.filter("later").select("doc", "row", "start", "n")
    rest = judged.filter("NOT later").dropDuplicates(["key", "doc", "row", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "context"):
                doc, row, start, n = (part.column(i).to_numpy() for i in range(4))
                data, bounds = text_bytes(part.column(4).cast(pa.large_binary()).view(pa.large_string()))
                context = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
                at = bounds[context] + nth
                one, two = (_gram_hashes(data, length, seed)[at].view(np.int64) for seed in (101, 202))
                out = [one, two, doc[context], row[context], start[context] + nth]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["one", "two", "doc", "row", "start"])

    windows = rest.select("doc", "row", "start", "n", "context").mapInArrow(
        run, "one bigint, two bigint, doc bigint, row bigint, start bigint"
    )
    later = _settle_rows(store(windows, "windows"), ["one", "two"]).filter("later")
    return whole.unionByName(later.select("doc", "row", "start", F.lit(1).cast("long").alias("n")))


def _settle_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Add ``later``: an equal string is in an earlier document, or earlier in the same row."""
    by_row = df.groupBy(*key, "doc", "row").agg(F.min("start").alias("row_first"))
    by_key = by_row.groupBy(*key).agg(F.min("doc").alias("first_doc"))
    joined = df.join(by_key, key).join(by_row, [*key, "doc", "row"])
    return joined.withColumn("later", (F.col("doc") > F.col("first_doc")) | (F.col("start") > F.col("row_first")))


@F.arrow_udf(_COVER)
def _cover(texts: pa.Array, runs: pa.Array) -> pa.Array:
    data, bounds = text_bytes(texts)
    own, _, starts, ends = _flat_spans(runs)
    own, _, start, size = _runs(own, np.zeros(len(own), np.int64), starts, ends - starts)
    ends = start + size
    removed = np.bincount(own, size, len(texts)).astype(np.int64)
    per_text = np.bincount(own, minlength=len(texts))
    first = np.cumsum(per_text) - per_text
    digests = []
    for i in range(len(texts)):
        mine = slice(first[i], first[i] + per_text[i])
        digest = hashlib.sha256()
        for piece in _kept(data[bounds[i] : bounds[i + 1]], start[mine], ends[mine]):
            digest.update(piece)
        digests.append(digest.hexdigest())
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(ends)], names=["start", "end"])
    listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(start)).astype(np.int32)), spans)
    columns = [pa.array(np.diff(bounds)), pa.array(removed), pa.array(digests, pa.string()), listed]
    return pa.StructArray.from_arrays(columns, names=_COVER.names)


def _flat_spans(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row of each span, where each row's begin, and the spans; null lists are empty."""
    if pa.types.is_null(lists.type):
        lists = lists.cast(pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    own = np.repeat(np.arange(len(lists)), size)
    return own, np.cumsum(size) - size, *[flat.field(i).to_numpy().astype(np.int64) for i in (0, 1)]


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
    at = 0
    for start, end in zip(starts.tolist(), ends.tolist()):
        yield memoryview(data[at:start])
        at = end
    yield memoryview(data[at:])


@F.arrow_udf(T.BinaryType())
def kept_bytes(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """A text's bytes without those of its spans; characters may be cut in two. Null stays null."""
    data, bounds = text_bytes(texts)
    own, first, starts, ends = _flat_spans(spans)
    first = np.append(first, len(own))
    out = [
        b"".join(_kept(data[bounds[i] : bounds[i + 1]], starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]))
        for i in range(len(texts))
    ]
    return pa.array(out, pa.binary(), mask=pc.is_null(texts).to_numpy(zero_copy_only=False))


def find_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    outputs: tuple[str, str, str, str] = ("n_bytes", "n_removed", "kept_sha256", "spans"),
    shard_bytes: int = SHARD_BYTES,
    shard_hashes: int = SHARD_HASHES,
) -> DataFrame:
    """Every document with its ``spans``: byte ranges (end excluded) of the UTF-8 text to remove.

    A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a
    document of smaller id, or further left in its own. Strings are those of the input, whatever is
    removed of it; they never cross documents and may overlap. With the spans come the text's bytes,
    the removed ones, and the SHA-256 of those kept; ``kept_bytes`` returns them.

    Ids are integers; null ids come after all others. Rows of equal ids are separate documents, none of
    them earlier than the other, so repeated rows get the same result. Null texts count as empty;
    texts of fewer than ``length`` bytes have no spans. An empty table gives no rows. Columns of
    the input that have a name of ``outputs`` give way.
    """
    pre = free_prefix([*docs.columns, *outputs], "_rep_")
    doc = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST_ID))
    several = docs.groupBy(doc.alias("doc")).count().filter("count > 1")
    # Only rows of equal ids have to be told apart.
    row = F.lit(0).cast("long") if several.isEmpty() else F.xxhash64(F.col(f"`{text}`"))
    texts = docs.select(doc.alias("doc"), row.alias("row"), F.col(f"`{text}`").alias("text")).filter(
        F.octet_length("text") >= length
    )
    settled = store(_settle_hashes(_hashed(texts, length, _frequent(texts, length)), shard_hashes), "settled")
    late = _settle_rows(settled.filter("digest IS NOT NULL"), ["hash", "digest"])
    open_ = settled.filter("hash IS NOT NULL AND digest IS NULL").unionByName(
        late.filter("NOT later").dropDuplicates(["hash", "digest", "doc", "row"]).select(*settled.columns)
    )
    found = store(_meet(_cut(texts, open_, length), length, shard_bytes), "repeats")
    places = ["doc", "row", "start", "n"]
    stretches = settled.filter("hash IS NULL").select(*places).unionByName(late.filter("later").select(*places))
    stretches = stretches.unionByName(found.filter("context IS NULL").select(*places))
    large = found.filter("context IS NOT NULL")
    if not large.isEmpty():
        stretches = stretches.unionByName(_judge_by_aggregation(large, length))
    run = F.struct(F.col("start"), (F.col("start") + F.col("n") + length - 1).alias("end"))
    runs = stretches.groupBy(F.col("doc").alias(f"{pre}d"), F.col("row").alias(f"{pre}r")).agg(
        F.collect_list(run).alias(f"{pre}runs")
    )
    joined = docs.join(runs, (doc == F.col(f"{pre}d")) & (row == F.col(f"{pre}r")), "left")
    covered = joined.withColumn(f"{pre}c", _cover(F.col(f"`{text}`"), F.col(f"{pre}runs")))
    low = {c.lower() for c in outputs}
    fields = ("n_bytes", "n_removed", "kept_sha256", "spans")
    return covered.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in low],
        *[F.col(f"{pre}c.{f}").alias(o) for f, o in zip(fields, outputs)],
    )

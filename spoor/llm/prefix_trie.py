"""The trie of conversation prefixes: which first turns conversations share.

1. A turn becomes a fixed-width id, the MD5 of its role and text; texts are read once and never
   shuffled. A conversation is the string of its ids, and equal ones are one path.
2. Paths are range-partitioned into chunks of bounded size, so a first turn that a third of all
   conversations share is spread over as many chunks as it takes. Each chunk becomes an adaptive
   radix tree over the bytes of its paths; only depths that are whole turns make nodes.
3. Only prefixes shared with the chunk before or behind are open. A node belongs to the first chunk
   it appears in, and that chunk alone counts it, so the parts of open nodes add up. All other nodes
   are finished where they are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.common import store
from spoor.llm.radix_tree import Node, RadixTree

WIDTH = 16
# Ids of conversations that end alike are joined to texts by ranges of so many ids.
ID_RANGE = 100_000
# A chunk has about so many paths, and so many bytes of them, at most.
CHUNK_PATHS, CHUNK_BYTES = 20_000, 8 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()
_PARTS = (
    "node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, is_open boolean, parent_open boolean"
)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``, an array of (id, size) in the order of turns, null first.

    ``size`` is the text's UTF-8 bytes. Null roles and texts are empty; turns of equal number come in
    the order of their ids; repeated rows are repeated turns. Rows without a conv_id belong to no
    conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct("turn", F.unhex(F.md5(told.cast("binary"))).alias("id"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def shared_heads(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations whose first turns are those of the last one before them divisible by ``every``.

    How many, less than ``most``, tells the checksum of the id. A conversation with fewer lends all
    it has, an absent one none; then come the conversation's own turns behind its first so many.
    """
    conversations = store(conversations, "conversations")
    many = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    lent = conversations.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("lender"), F.slice("turns", 1, most - 1).alias("lent")
    )
    asked = conversations.select("conv_id", "turns", many.alias("many"), (F.col("conv_id") - F.col("conv_id") % every).alias("from"))
    joined = asked.join(lent, F.col("from") == F.col("lender"), "left")
    none = F.slice("turns", 1, 0)
    head = F.coalesce(F.slice("lent", F.lit(1), F.col("many")), none)
    own = F.when(F.size("turns") > F.col("many"), F.slice("turns", F.col("many") + 1, F.size("turns"))).otherwise(none)
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def _distinct_paths(conversations: DataFrame) -> DataFrame:
    """path, sizes, n, conv_id (the least) and ends: SHA-256 of the ids of all conversations on the path."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    found = conversations.select("conv_id", path.alias("path"), F.col("turns.size").alias("sizes"))
    bounded = found.groupBy(F.md5("path").alias("key"), F.expr(f"conv_id DIV {ID_RANGE}").alias("range")).agg(
        F.first("path").alias("path"),
        F.first("sizes").alias("sizes"),
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("conv_id"),
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
    )
    names = ["path", "sizes", "n", "conv_id", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A path that very many conversations end on comes in many rows, whose ids stream through.
        key, held, digest = None, None, None
        for batch in batches:
            out = []
            for i, (own, ids) in enumerate(zip(batch.column(0).to_pylist(), batch.column(6).to_pylist())):
                if own == key:
                    held[2] += batch.column(4)[i].as_py()
                    digest.update(b",")
                else:
                    if held is not None:
                        out.append((*held, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                    held = [batch.column(c)[i].as_py() for c in (2, 3, 4, 5)]
                digest.update(ids.encode())
            yield _path_batch(out, names)
        if held is not None:
            yield _path_batch([(*held, digest.hexdigest())], names)

    ordered = bounded.select("key", "range", "path", "sizes", "n", "conv_id", "ids").repartition("key")
    return ordered.sortWithinPartitions("key", "range").mapInArrow(
        run, "path binary, sizes array<bigint>, n bigint, conv_id bigint, ends string"
    )


def _path_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


@F.arrow_udf(T.IntegerType())
def _shared_turns(one: pa.Array, two: pa.Array) -> pa.Array:
    """Whole turns that two paths begin with alike; -1 if one of them is missing."""
    out = []
    for a, b in zip(one.to_pylist(), two.to_pylist()):
        if a is None or b is None:
            out.append(-1)
            continue
        n = min(len(a), len(b))
        differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
        out.append(int(differ[0] if len(differ) else n) // WIDTH)
    return pa.array(out, pa.int32())


def _chunks(paths: DataFrame, chunk_paths: int) -> DataFrame:
    """The paths with the number of their chunk, and how much its ends share with its neighbours."""
    many, size = paths.agg(F.count(F.lit(1)), F.sum(F.octet_length("path"))).first()
    chunks = max(1, -(-many // chunk_paths), -(-(size or 0) // CHUNK_BYTES))
    dealt = store(paths.repartitionByRange(chunks, "path").withColumn("chunk", F.spark_partition_id()), "chunks")
    ends = dealt.groupBy("chunk").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    # One row per chunk.
    order = Window.orderBy("chunk")
    ends = ends.select("chunk", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("behind"))
    shared = ends.select(
        "chunk", _shared_turns("before", "first").alias("shared_before"), _shared_turns("last", "behind").alias("shared_behind")
    )
    return dealt.join(shared, "chunk")


@dataclass
class _Sum:
    """What lies below some depth: ``heads`` are the nodes next below, ``owned`` those counted here."""

    heads: int = 0
    owned: int = 0
    convs: int = 0
    least: int | None = None
    leaves: int = 0
    saved: int = 0

    def add(self, other: _Sum) -> None:
        self.heads += other.heads
        self.owned += other.owned
        self.convs += other.convs
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.leaves += other.leaves
        self.saved += other.saved


@dataclass
class _Frame:
    """A tree node on the way down: its bytes end at depth ``bottom``."""

    node: Node
    bottom: int
    marks: list[tuple[bytes, bool]]  # key and openness of the last turn-aligned depth above, and of those within its bytes
    children: list[Node]
    on_first: bool
    on_last: bool
    below: _Sum


def _nodes(tree: RadixTree, paths: list[bytes], sizes, n, conv, ends, shared_before: int, shared_behind: int) -> list[tuple]:
    """A row for every depth of whole turns; tree values are places in the lists."""
    out: list[tuple] = []

    def enter(node: Node, above: int, last: tuple[bytes, bool] | None, on_first: bool, on_last: bool) -> _Frame:
        bottom = above + len(node.prefix)
        path = paths[node.sample]
        marks = [] if last is None else [last]
        for turn in range(0 if last is None else (above - 1) // WIDTH + 1, bottom // WIDTH + 1):
            told = marks[-1][0] + path[(turn - 1) * WIDTH : turn * WIDTH] if turn else b""
            is_open = (on_first and turn <= shared_before) or (on_last and turn <= shared_behind)
            marks.append((hashlib.md5(told).digest(), is_open))
        below = _Sum()
        if node.value is not None:
            below = _Sum(convs=n[node.value], least=conv[node.value])
        children = [child for _, child in node.children.items()]
        return _Frame(node, bottom, marks, children[::-1], on_first, on_last, below)

    def leave(frame: _Frame, above: int) -> _Sum:
        node, below = frame.node, frame.below
        turn = frame.bottom // WIDTH
        while turn * WIDTH >= above:
            continued = frame.on_first and turn <= shared_before
            goes_on = frame.on_last and turn <= shared_behind
            size = sizes[node.sample][turn - 1] if turn else 0
            below.leaves += below.heads == 0 and not goes_on
            below.saved += (below.convs - (not continued)) * size
            end = ends[node.value] if node.value is not None and turn * WIDTH == frame.bottom else None
            key, is_open = frame.marks.pop()
            parent, parent_open = frame.marks[-1] if turn else (None, False)
            sums = (below.convs, below.owned, below.leaves, below.saved)
            out.append((key, parent, turn, below.least, *sums, end, is_open, parent_open))
            below = _Sum(1, int(not continued), below.convs, below.least, below.leaves, below.saved)
            turn -= 1
        return below

    stack = [(enter(tree.root, 0, None, True, True), 0)]
    while stack:
        frame, above = stack[-1]
        if frame.children:
            child = frame.children.pop()
            on_first = frame.on_first and not frame.below.heads
            # One byte leads to the child.
            entered = enter(child, frame.bottom + 1, frame.marks[-1], on_first, frame.on_last and not frame.children)
            stack.append((entered, frame.bottom + 1))
        else:
            stack.pop()
            done = leave(frame, above)
            if stack:
                stack[-1][0].below.add(done)
    return out


def _trie_parts(chunks: DataFrame) -> DataFrame:
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.bool_(), pa.bool_()]
    names = [part.split()[0] for part in _PARTS.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_pylist() for c in ("path", "n", "conv_id", "ends")}
        listed = group.column("sizes").combine_chunks()
        bounds, flat = listed.offsets.to_numpy(), listed.values.to_numpy()
        sizes = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        tree = RadixTree()
        for i in sorted(range(len(sizes)), key=columns["path"].__getitem__):
            tree.insert(columns["path"][i], i)
        before, behind = (group.column(c)[0].as_py() for c in ("shared_before", "shared_behind"))
        rows = _nodes(tree, columns["path"], sizes, columns["n"], columns["conv_id"], columns["ends"], before, behind)
        least = {row[0]: row[3] for row in rows}
        fields = list(zip(*rows))
        parents = [None if open_ else least.get(parent) for parent, open_ in zip(fields[1], fields[10])]
        fields = [*fields[:4], parents, *fields[4:]]
        return pa.table({c: pa.array([None if v is None else v for v in f], k) for c, f, k in zip(names, fields, kinds)})

    return chunks.groupBy("chunk").applyInArrow(run, _PARTS)


def prefix_trie(conversations: DataFrame, chunk_paths: int = CHUNK_PATHS) -> DataFrame:
    """A row for every distinct sequence of first turns of (conv_id, turns); ids are distinct.

    conv_id is the least of the conversations that begin so, ``n_convs`` their number, ``depth`` the turns,
    ``parent_conv_id`` the conv_id of the node one turn shorter (null for the root, which is there if any
    conversation is, and which one without turns ends on). ``n_children``; ``n_leaves``, the
    childless nodes of the subtree, the node included; ``saved_tokens``, the bytes of last turns in
    the subtree times the conversations beyond the first; ``ends_sha256`` of the ids, ascending and comma-joined,
    of conversations that end there.

    A conversation, 24 bytes a turn, is held by one task, as is a chunk of paths; nothing else is.
    An empty table gives no rows.
    """
    paths = store(_distinct_paths(conversations), "paths")
    parts = store(_trie_parts(_chunks(paths, chunk_paths)), "nodes")
    merged = store(
        parts.filter("is_open")
        .groupBy("node")
        .agg(
            F.first("parent").alias("parent"),
            F.first("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends_sha256").alias("ends_sha256"),
        ),
        "open",
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    waiting = parts.filter("NOT is_open AND parent_open").drop("parent_conv_id").select(*merged.columns).unionByName(merged)
    known = merged.select(F.col("node").alias("_node"), F.col("conv_id").alias("parent_conv_id"))
    found = waiting.join(known, F.col("parent") == F.col("_node"), "left").select(*columns)
    found = found.unionByName(parts.filter("NOT is_open AND NOT parent_open").select(*columns))
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))

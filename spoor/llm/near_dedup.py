"""Near-duplicate documents by BagMinHash signatures, banding and verified bags.

1. Equal texts are one node (MD5 of the text), so copies cost a row each and no comparison.
2. Each node's signature of ``BANDS * ROWS`` places gives a key per band. Nodes that share a key
   share a bucket.
3. Every bucket compares its members with one of them, the pivot; pairs are verified on their whole
   bags, and verified links are joined to components. Members of one component need no further
   comparison, so a large group of close copies costs a row per member and band.
4. In a bucket that still holds several components, members of different ones are compared: a
   small one emits the pairs, a large one compares blocks of members by matrix products and emits
   no more links than it takes to join them. No verified link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.bagminhash import bags, band_keys, overlaps, signatures, similarity, sizes
from spoor.llm.common import free_prefix, store
from spoor.llm.components import components
from spoor.llm.words import chunks, words_of

SHINGLE = 5
LEAST = 0.8
# Two bags with similarity 0.8 agree in a whole band with 0.33; all 25 bands miss with 5 in 100,000.
BANDS, ROWS = 25, 5
SMALL_BUCKET = 32
BLOCK = 256
# A set of nodes up to this size is sent to all tasks; a larger one is joined by shuffling.
BROADCAST_NODES = 500_000


def _sign(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node and the band keys (null without words); the texts end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = words_of(part.column(part.schema.get_field_index("text")))
                text, key, weight = bags(words, shingle)
                signed = signatures(text, key, weight, part.num_rows, BANDS * ROWS)
                keys = band_keys(signed, BANDS, ROWS).view(np.int64)
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * BANDS
                listed = pa.ListArray.from_arrays(
                    pa.array(ends, mask=np.append(words.counts == 0, False)), pa.array(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), listed], names=["doc_id", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", _node().alias("node"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, node binary, bands array<bigint>")


def _node():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _verify(pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """a, b, similarity of the pairs (a, text_a, b, text_b) that reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_a"):
                cols = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                sides = []
                for side in ("text_a", "text_b"):
                    text, key, weight = bags(words_of(cols[side]), shingle)
                    at = sizes(text, part.num_rows)
                    sides.append([(key[s:e], weight[s:e]) for s, e in zip(at[:-1], at[1:])])
                found = np.array([similarity(x, y) for x, y in zip(*sides)])
                good = pa.array(np.flatnonzero(found >= least))
                yield pa.RecordBatch.from_arrays(
                    [cols["a"].take(good), cols["b"].take(good), pa.array(found).take(good)], names=["a", "b", "similarity"]
                )

    return pairs.mapInArrow(run, "a binary, b binary, similarity double")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text, read from one document of each node."""
    n = nodes.count()
    wanted = nodes.select(F.col("node").alias("wanted"), "rep")
    if n <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    at = (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    return docs.select("doc_id", "text", _node().alias("node")).join(wanted, at).select("node", "text")


def link_nodes(docs: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """Verified links (a, b, similarity) that join all nodes which similar pairs in buckets join."""
    keyed = nodes.select("node", F.posexplode("bands").alias("nth", "band")).select(
        F.xxhash64("nth", "band").alias("bucket"), "node"
    )
    full = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = store(keyed.join(full, "bucket"), "members")
    # The pivot is the member that meets most others in all its buckets: the middle of its group.
    met = members.withColumn("met", F.sum("n").over(Window.partitionBy("node")))
    pivots = met.groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("pivot"))
    members = store(members.join(pivots, "bucket"), "pivoted")
    active = members.select("node").distinct()
    texts = store(_texts_of(docs, store(nodes.select("node", "rep").join(active, "node"), "active")), "texts")

    starred = members.filter("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    links = store(_verify(_with_texts(starred.distinct(), texts), shingle, least), "links")
    rest = members.filter("node <> pivot").join(components(links), "node", "left")
    rest = rest.select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = rest.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")
    )
    rest = store(rest.join(mixed.filter("r0 <> r1").select("bucket", "n"), "bucket"), "rest")

    small = rest.filter(F.col("n") <= SMALL_BUCKET).select("bucket", F.col("node").alias("a"), F.col("root").alias("root_a"))
    other = small.select("bucket", F.col("a").alias("b"), F.col("root_a").alias("root_b"))
    crossed = small.join(other, "bucket").filter("a < b AND root_a <> root_b").select("a", "b").distinct()
    crossed = crossed.join(starred.distinct(), ["a", "b"], "left_anti")
    large = _link_blocks(rest.filter(F.col("n") > SMALL_BUCKET), texts, shingle, least)
    return links.unionByName(_verify(_with_texts(crossed, texts), shingle, least)).unionByName(large)


def _link_blocks(members: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links between different components of large buckets, all pairs compared block by block.

    A bucket is dealt into blocks; each pair of blocks is a group of its own, whose bags become
    two matrices over the shingles: their product is the overlap of every pair. Of the links found
    only so many are returned as it takes to join their members.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("i", F.pmod(F.xxhash64("node"), blocks).cast("int")).select(
        "bucket", "node", "root", "i", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j")
    )
    paired = dealt.select(
        "bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", "root"
    ).join(texts, "node")

    def run(group: pa.Table) -> pa.Table:
        batch = group.combine_chunks()
        text, key, weight = bags(words_of(batch["text"].chunk(0)), shingle)
        side = batch["i"].to_numpy()
        one = np.flatnonzero(side == batch["lo"][0].as_py())
        two = np.flatnonzero(side == batch["hi"][0].as_py())
        root = np.unique(np.array(batch["root"].to_pylist(), dtype=object), return_inverse=True)[1]
        found = overlaps(text, key, weight, group.num_rows, one, two)
        near = (found >= least) & (root[one][:, None] != root[two][None, :])
        parent = list(range(group.num_rows))
        a, b, how = [], [], []

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(*np.nonzero(near)):
            p, q = top(int(one[x])), top(int(two[y]))
            if p != q:
                parent[p] = q
                a.append(int(one[x]))
                b.append(int(two[y]))
                how.append(float(found[x, y]))
        node = batch["node"].chunk(0)
        return pa.table(
            {"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64())), "similarity": pa.array(how, pa.float64())}
        )

    return paired.groupBy("bucket", "lo", "hi").applyInArrow(run, "a binary, b binary, similarity double")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """doc_id, node, ``class_id``, ``kept`` and ``has_words`` of every row of (doc_id, text).

    ``class_id`` is the least doc_id among the documents that equal texts and verified links of
    similarity ``least`` or more connect; links join classes, so two members of one class may be
    less similar to each other. Null ids count as greater than all others. ``kept`` marks the
    document of that id (of several with it, the text of least MD5), and all its repeated rows.
    Null texts and texts without words are in no one's class: their class_id is their own doc_id,
    and they are kept. Bands miss a pair of similarity 0.8 with a chance of 5 in 100,000.
    """
    signed = store(_sign(docs.select("doc_id", "text"), shingle), "signed")
    nodes = store(
        signed.filter("bands IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")),
        "nodes",
    )
    links = link_nodes(docs.select("doc_id", "text"), nodes, shingle, least)
    root = components(links)
    rooted = nodes.select("node", "rep").join(root, "node", "left").select(
        F.col("node").alias("_node"), "rep", F.coalesce("root", "node").alias("root")
    )
    first = F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("_node"))).alias("first")
    firsts = rooted.groupBy(F.col("root").alias("_root")).agg(first)
    classes = rooted.join(firsts, F.col("root") == F.col("_root")).select(
        "_node", F.col("first.rep").alias("class_id"), F.col("first._node").alias("class_node")
    )
    has_words = F.col("bands").isNotNull()
    is_first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))
    return signed.join(classes, has_words & (F.col("node") == F.col("_node")), "left").select(
        "doc_id",
        "node",
        F.when(has_words, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        (~has_words | is_first).alias("kept"),
        has_words.alias("has_words"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one of the least doc_id, with all its columns.

    Null texts and texts without words all stay. The rows to leave out are the right side of an
    anti join, so only they and the ids are shuffled when they are too many to be sent to all.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = store(near_duplicates(own), "classes")
    gone_id, gone_node = (f"{free_prefix(docs.columns, '_gone')}_{c}" for c in ("id", "node"))
    named = [F.col("doc_id").alias(gone_id), F.col("node").alias(gone_node)]
    gone = found.filter("NOT kept").select(*named).distinct()
    # Repeated rows of a kept document: taken out as well, and one of them is put back.
    repeated = found.filter("kept AND has_words").groupBy(*named).count().filter("count > 1").drop("count")
    node = F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))
    at = F.col(f"`{doc_id}`").eqNullSafe(F.col(gone_id)) & (node == F.col(gone_node))
    if gone.count() <= BROADCAST_NODES:
        gone = F.broadcast(gone)
    if repeated.isEmpty():
        return docs.join(gone, at, "left_anti")
    once = docs.join(repeated, at, "left_semi").dropDuplicates([doc_id, text])
    return docs.join(gone.union(repeated), at, "left_anti").unionByName(once)

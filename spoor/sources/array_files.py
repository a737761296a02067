"""Files that hold one JSON array of documents, or one document, read in parallel and verbatim.

Spark's text reader cuts a file of any size into byte ranges; with ``}`` as the end of a line every
range finds a place to begin. Whether a brace is part of a string, and how deep it lies, depends on
all that stands before it: each range tells how it changes both, for either way it may begin, and
running sums over a file's ranges, a row each, tell how each begins. Then a range knows where its
documents end. Those that lie in one range are cut out there; what a range begins and ends with, two
texts, is joined with its neighbours'. No file is read by one task, nothing is parsed, and no whole
document is shuffled but those that cross a range's edge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions.carry import along
from spoor.session import scratch_path

_QUOTE, _OPENS, _BRACKET, _BRACE = 1, 2, 3, 4
_KIND = np.zeros(256, np.int8)
_KIND[[ord(c) for c in '"{[]}']] = [_QUOTE, _OPENS, _OPENS, _BRACKET, _BRACE]
_STEP = np.array([0, 0, 1, -1, -1], np.int64)
_BLANK = re.compile("^[ \t\n\x0b\f\r\ufeff]+")
_RANGE = "file string, block long, pieces long, bytes long, file_size long, quotes int, net_outside long, net_in_string long, head string"
_EDGE = "file string, block long, part int, ends int, text string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files' texts between braces, in order within a byte range."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("piece"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The parts of a batch that come from one range."""
    files = pc.run_end_encode(batch.column("file")).run_ends.to_numpy()
    blocks = np.flatnonzero(np.diff(batch.column("block").to_numpy())) + 1
    cuts = np.unique(np.concatenate([[0], files, blocks]))
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(start, end - start)


def _text(pieces: pa.Array, unclosed: bool = False) -> np.ndarray:
    """The bytes of the pieces, a brace behind each; ``unclosed``: not behind the last."""
    braces = ["}"] * len(pieces)
    if unclosed:
        braces[-1] = ""
    joined = pc.binary_join_element_wise(pieces, pa.array(braces), "")
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)


def _marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and kinds of quotes, brackets and braces, and whether the quotes up to each are odd.

    An escaped character is none of them; a brace that ends a piece is never escaped.
    """
    places = np.flatnonzero(_KIND[text])
    slashes = np.flatnonzero(text == ord("\\"))
    if len(slashes):
        firsts = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        lengths = np.diff(firsts, append=len(slashes))
        escaped = slashes[firsts][lengths % 2 == 1] + lengths[lengths % 2 == 1]
        escaped = escaped[escaped < len(text)]
        places = np.setdiff1d(places, escaped[text[escaped] != ord("}")], assume_unique=True)
    kinds = _KIND[text[places]]
    return places, kinds, np.cumsum(kinds == _QUOTE) & 1


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each range changes depth and string state, its size, and its first character."""
    names = [c.split()[0] for c in _RANGE.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _RANGE.split(", ")])
    now = None
    for batch in batches:
        for run in _runs(batch):
            file, block = run.column("file")[0].as_py(), run.column("block")[0].as_py()
            if now is None or (now["file"], now["block"]) != (file, block):
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now], schema)
                first = run.column("piece")[0].cast(pa.binary()).as_py().decode("utf-8", "replace")
                size = run.column("file_size")[0].as_py()
                now = dict(zip(names, (file, block, 0, 0, size, 0, 0, 0, _BLANK.sub("", first)[:1])))
            text = _text(run.column("piece"))
            _, kinds, odd = _marks(text)
            even_net, odd_net = int(_STEP[kinds[odd == 0]].sum()), int(_STEP[kinds[odd == 1]].sum())
            if now["quotes"]:
                even_net, odd_net = odd_net, even_net
            now["net_outside"] += even_net
            now["net_in_string"] += odd_net
            now["quotes"] ^= int(odd[-1]) if len(odd) else 0
            now["pieces"] += run.num_rows
            now["bytes"] += len(text)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now], schema)


def _begun(spark: SparkSession, path: str, slice_rows: int | None) -> DataFrame:
    """A row per range: how deep it begins, whether in a string, and whether a brace follows its last piece."""
    target = scratch_path(spark, "ranges")
    _pieces(spark, path).mapInArrow(_ranges, _RANGE).write.parquet(target)
    told = spark.read.schema(_RANGE).parquet(target)
    # With a brace for each piece a file has its size; one byte more if the last piece has none, and
    # three less if the reader skipped a byte order mark.
    surplus = F.sum("bytes") - F.max("file_size")
    files = told.groupBy("file").agg(
        F.max("block").alias("last"),
        (F.pmod(surplus, F.lit(3)) == 1).alias("open_end"),
        (F.min_by("head", "block") == "[").cast("long").alias("listed"),
    )
    placed = along(told, ["file"], ["block"], running={"quotes_to": F.col("quotes")}, slice_rows=slice_rows)
    in_string = F.pmod(F.col("quotes_to") - F.col("quotes"), F.lit(2))
    change = F.when(in_string == 1, F.col("net_in_string")).otherwise(F.col("net_outside"))
    placed = placed.withColumn("in_string", in_string.cast("int")).withColumn("change", change)
    deep = along(placed, ["file"], ["block"], running={"depth_to": F.col("change")}, slice_rows=slice_rows)
    unclosed = F.when(F.col("open_end") & (F.col("block") == F.col("last")), F.col("pieces")).otherwise(-1)
    begun = deep.join(files, "file").select(
        "file", "block", "in_string", (F.col("depth_to") - F.col("change")).alias("depth"), "listed", unclosed.alias("unclosed_at")
    )
    target = scratch_path(spark, "begun")
    begun.write.parquet(target)
    return spark.read.schema(begun.schema).parquet(target)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, block, text, ends): the bytes of one range after another with the places behind each document."""
    now = None
    for batch in batches:
        for run in _runs(batch):
            key = run.column("file")[0].as_py(), run.column("block")[0].as_py()
            if key != now:
                now, seen = key, 0
                in_string, depth, listed, unclosed_at = (
                    run.column(c)[0].as_py() for c in ("in_string", "depth", "listed", "unclosed_at")
                )
            seen += run.num_rows
            text = _text(run.column("piece"), seen == unclosed_at)
            places, kinds, odd = _marks(text)
            outside = odd == in_string
            depths = depth + np.cumsum(np.where(outside, _STEP[kinds], 0))
            ends = places[(kinds == _BRACE) & outside & (depths == listed)] + 1
            yield *key, text, ends
            if len(places):
                depth, in_string = int(depths[-1]), in_string ^ int(odd[-1])


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each range but the text up to its first end and behind its last."""
    now, rest = None, None
    for file, block, text, ends in _cut(batches):
        if (file, block) != now:
            now, rest = (file, block), None
        if len(ends):
            if rest is not None:
                rest.append(text[: ends[0]].tobytes())
                yield _texts([b"".join(rest)])
            if len(ends) > 1:
                offsets = pa.py_buffer(ends.astype(np.int32))
                listed = pa.StringArray.from_buffers(len(ends) - 1, offsets, pa.py_buffer(np.ascontiguousarray(text)))
                yield pa.RecordBatch.from_arrays([listed], names=["text"])
            rest = [text[ends[-1] :].tobytes()]
        elif rest is not None:
            rest.append(text.tobytes())


def _texts(found: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).view(pa.string())], names=["text"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each range up to its first end, and behind its last."""

    def row(key, part, ends, parts):
        columns = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([part], pa.int32()), pa.array([ends], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, _texts([b"".join(parts)]).column(0)], names=[c.split()[0] for c in _EDGE.split(", ")])

    now, part, parts = None, 0, []
    for file, block, text, ends in _cut(batches):
        if (file, block) != now:
            if now is not None:
                yield row(now, part, 0, parts)
            now, part, parts = (file, block), 0, []
        if len(ends):
            if part == 0:
                yield row(now, 0, 1, [*parts, text[: ends[0]].tobytes()])
            part, parts = 1, [text[ends[-1] :].tobytes()]
        else:
            parts.append(text.tobytes())
    if now is not None:
        yield row(now, part, 0, parts)


def read_array_files(spark: SparkSession, path: str, slice_rows: int | None = None) -> DataFrame:
    """``receipt_json``: every document's text as it stands in the file, whatever the file's size.

    What stands between documents is left out if it is blanks, commas and the array's brackets, and
    else belongs to the document behind it; so does what a file cut short ends with. Such text is no
    document to the ingest gate.
    """
    begun = _begun(spark, path, slice_rows)
    # A row per range.
    pieces = _pieces(spark, path).drop("file_size").join(F.broadcast(begun), ["file", "block"])
    target = scratch_path(spark, "edges")
    pieces.mapInArrow(_edges, _EDGE).write.parquet(target)
    edges = spark.read.schema(_EDGE).parquet(target)
    numbered = along(
        edges.drop("text"), ["file"], ["block", "part"], running={"ended": F.col("ends")}, slice_rows=slice_rows
    ).select("file", "block", "part", (F.col("ended") - F.col("ends")).alias("document"))
    joined = edges.join(numbered, ["file", "block", "part"]).groupBy("file", "document")
    listed = F.array_sort(F.collect_list(F.struct("block", "part", "text")))
    crossing = joined.agg(F.array_join(F.transform(listed, lambda p: p["text"]), "").alias("text")).select("text")
    documents = pieces.mapInArrow(_inner, "text string").unionByName(crossing)
    own = F.regexp_replace(F.regexp_replace("text", r"^[\s\uFEFF]*(?:\[\s*)?(?:,\s*)?", ""), r"\s+$", "")
    return documents.select(own.alias("receipt_json")).filter("receipt_json NOT IN ('', ']')")

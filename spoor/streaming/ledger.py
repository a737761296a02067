"""A table that takes every id once, whoever delivers it and however often.

``path`` is a plain Parquet table with a folder ``batch=<commit>`` per commit. Beside it, where Spark
does not look for data:

- ``_ledger/<commit>.json``: what holds since that commit. Writing the next number is the commit; two
  writers cannot both succeed, and the one that fails starts again from what the other left.
- ``_pending/<attempt>``: rows and ids of an attempt. Once committed they are moved in place, by the
  writer or, if it was lost, by whoever opens the table next. Other attempts' leftovers are never seen.
- ``_ids/<index>/bucket=<k>``: the ids by hash. A batch reads the buckets of its own ids. When buckets
  have got too many ids or files, the index is written anew with more buckets, each with one file;
  that is done so seldom that its cost per id stays the same however long the trail is.

Needs a file system whose rename fails if the target exists, as Spark's own checkpoints do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators.quality import dedupe_ids

BUCKET_IDS = 4096
LEAST_BUCKETS = 16
# Index files per bucket, on average, before the index is written anew.
BUCKET_FILES = 8
# A batch that needs more buckets than this reads the whole index.
MOST_BUCKETS = 50_000
KEPT_ENTRIES = 32


class _Files:
    """The few file operations Spark has no DataFrame for."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, [] if there is none; Spark's and the file system's side files left out."""
        if not self.exists(path):
            return []
        found = [status.getPath().getName() for status in self.fs.listStatus(self.path(path))]
        return sorted(n for n in found if not n.startswith(".") and n != "_SUCCESS")

    def move(self, source: str, target: str) -> bool:
        """False if another writer moved it first, or the target is there."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(options.valueOf("NONE").getDeclaringClass(), 1)
        how[0] = options.valueOf("NONE")
        try:
            self.fs.mkdirs(self.path(target).getParent())
            context.rename(self.fs.makeQualified(self.path(source)), self.fs.makeQualified(self.path(target)), how)
        except Py4JJavaError:
            if self.exists(source) and not self.exists(target):
                raise
            return False
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


@dataclass(frozen=True)
class Entry:
    """What holds since a commit."""

    commit: int = -1
    attempt: str = ""
    rows: int = 0  # of this commit
    streams: dict[str, int] = field(default_factory=dict)  # the last batch taken of each
    index: str = ""
    buckets: int = LEAST_BUCKETS
    ids: int = 0
    files: int = 0
    old_index: str = ""


class IngestTable:
    def __init__(self, spark: SparkSession, path: str, bucket_ids: int = BUCKET_IDS):
        self.spark, self.path, self.bucket_ids = spark, path.rstrip("/"), bucket_ids
        self.files = _Files(spark, self.path)

    def append(self, batch: DataFrame, stream: str, batch_id: int, order: Sequence[str] = ("ts",)) -> Entry:
        """Append the rows whose id the table does not hold, the first of each id.

        A batch of a stream that was taken before is taken no second time. Rows without an id are
        one id: the first ever is stored.
        """
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            while True:
                entry = self.latest()
                if entry.streams.get(stream, -1) >= batch_id:
                    return entry
                attempt = uuid.uuid4().hex
                rows, files = self._stage(batch, entry, attempt, order)
                following = replace(
                    entry,
                    commit=entry.commit + 1,
                    attempt=attempt,
                    rows=rows,
                    streams={**entry.streams, stream: batch_id},
                    ids=entry.ids + rows,
                    files=entry.files + files,
                )
                if self._commit(following):
                    self._publish(following)
                    return self._renewed(following)
                self.files.delete(f"{self.path}/_pending/{attempt}")
        finally:
            batch.unpersist()

    def latest(self) -> Entry:
        """The last commit, moved in place if its writer was lost before that."""
        names = self.files.names(f"{self.path}/_ledger")
        entries = [n for n in names if n.endswith(".json")]
        if not entries:
            entry = self._adopted()
            return entry if self._commit(entry) else self.latest()
        entry = Entry(**json.loads(self.files.read(f"{self.path}/_ledger/{entries[-1]}")))
        if entry.attempt and self.files.exists(f"{self.path}/_pending/{entry.attempt}"):
            self._publish(entry)
        return entry

    def bucket_paths(self, entry: Entry, ids: DataFrame) -> list[str]:
        """The folders of the index that may hold the ids."""
        folder = f"{self.path}/_ids/{entry.index}"
        wanted = ids.select(self._bucket(entry.buckets).alias("b")).distinct().limit(MOST_BUCKETS + 1).collect()
        if len(wanted) > MOST_BUCKETS:
            return [folder] if self.files.names(folder) else []
        paths = [f"{folder}/bucket={r['b']}" for r in wanted]
        return [p for p in paths if self.files.exists(p)]

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")

    def _stage(self, batch: DataFrame, entry: Entry, attempt: str, order: Sequence[str]) -> tuple[int, int]:
        """Write the new rows and their ids where nobody looks; how many rows and id files."""
        fresh = dedupe_ids(batch, order)
        paths = self.bucket_paths(entry, batch.select("id"))
        if paths:
            stored = self.spark.read.schema("id string").option("recursiveFileLookup", True).parquet(*paths)
            fresh = fresh.join(stored, fresh["id"].eqNullSafe(stored["id"]), "left_anti")
        pending = f"{self.path}/_pending/{attempt}"
        fresh.write.parquet(f"{pending}/data")
        ids = self.spark.read.schema(fresh.schema).parquet(f"{pending}/data").select("id")
        self._write_ids(ids, f"{pending}/ids", entry.buckets)
        return ids.count(), len(self.files.names(f"{pending}/ids"))

    def _write_ids(self, ids: DataFrame, folder: str, buckets: int) -> None:
        placed = ids.withColumn("bucket", self._bucket(buckets))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(folder)

    def _commit(self, entry: Entry) -> bool:
        """The next entry of the ledger, whole or not at all; False if another writer has it."""
        draft = f"{self.path}/_ledger/.{uuid.uuid4().hex}"
        self.files.write(draft, json.dumps(asdict(entry)))
        if self.files.move(draft, f"{self.path}/_ledger/{entry.commit:012d}.json"):
            return True
        self.files.delete(draft)
        return False

    def _publish(self, entry: Entry) -> None:
        """Move a committed attempt's rows and ids in place; may be done again, and by two at once."""
        pending = f"{self.path}/_pending/{entry.attempt}"
        for bucket in self.files.names(f"{pending}/ids"):
            for name in self.files.names(f"{pending}/ids/{bucket}"):
                source = f"{pending}/ids/{bucket}/{name}"
                self.files.move(source, f"{self.path}/_ids/{entry.index}/{bucket}/{entry.attempt}-{name}")
        if entry.rows and self.files.exists(f"{pending}/data"):
            self.files.move(f"{pending}/data", f"{self.path}/batch={entry.commit}")
        self.files.delete(pending)
        for name in self.files.names(f"{self.path}/_ledger")[:-KEPT_ENTRIES]:
            self.files.delete(f"{self.path}/_ledger/{name}")

    def _adopted(self) -> Entry:
        """The first entry, of a new table or of one that was written without a ledger."""
        folders = [n for n in self.files.names(self.path) if not n.startswith("_")]
        entry = Entry(index=uuid.uuid4().hex)
        if not folders:
            return entry
        numbers = [int(n.split("=")[1]) for n in folders if n.startswith("batch=")]
        ids = self.spark.read.parquet(self.path).select("id").distinct()
        many = ids.count()
        buckets = self._buckets_for(many)
        self._write_ids(ids, f"{self.path}/_ids/{entry.index}", buckets)
        return replace(entry, commit=max(numbers, default=-1) + 1, buckets=buckets, ids=many, files=buckets)

    def _buckets_for(self, ids: int) -> int:
        return max(LEAST_BUCKETS, 1 << (2 * ids // self.bucket_ids).bit_length())

    def _renewed(self, entry: Entry) -> Entry:
        """The index with more buckets or fewer files, if it is time; the one before the last goes."""
        full = entry.ids > entry.buckets * self.bucket_ids
        if not full and entry.files <= BUCKET_FILES * entry.buckets:
            return entry
        new, buckets = uuid.uuid4().hex, self._buckets_for(entry.ids)
        ids = self.spark.read.schema("id string").option("recursiveFileLookup", True).parquet(f"{self.path}/_ids/{entry.index}")
        self._write_ids(ids, f"{self.path}/_ids/{new}", buckets)
        renewed = replace(
            entry, commit=entry.commit + 1, attempt="", rows=0, index=new, buckets=buckets, files=buckets, old_index=entry.index
        )
        if not self._commit(renewed):
            self.files.delete(f"{self.path}/_ids/{new}")
            return entry
        if entry.old_index:
            self.files.delete(f"{self.path}/_ids/{entry.old_index}")
        return renewed

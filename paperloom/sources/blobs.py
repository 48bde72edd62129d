"""A content-addressed blob store: one file for each hash, whatever uploads it and however often."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, hadoop_path, remove

#: The largest blob, as uploads are bounded (a fixed value), and the hash's digits that name its folder.
MAX_BYTES, FAN_DIGITS = 30 * 1024 * 1024, 2
_DONE = "upload_id string, blob_hash string, byte_size long, problem string"


class CorruptBlob(ValueError):
    """A stored blob whose bytes are not those of its name, or a reference to a blob that is not there."""


def digests(chunks: DataFrame) -> DataFrame:
    """(upload_id, blob_hash, byte_size, problem) of uploads in chunks (upload_id, chunk from 0, data).

    Chunks are hashed in order with the state carried from one to the next, so
    a task holds one batch of chunks and a hash state, not the uploads.  A
    chunk that comes again with the same bytes counts once.  problem: missing
    (a gap), conflicting (one place, different bytes) or too large; such an
    upload has no hash.  A null chunk is an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, size, at, last, problem = None, None, 0, 0, b"", None

        def end() -> tuple:
            wrong = problem or ("too large" if size > MAX_BYTES else None)
            return now, None if wrong else state.hexdigest(), None if wrong else size, wrong

        for batch in batches:
            done = []
            for upload, chunk, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if upload != now:
                    if now is not None:
                        done.append(end())
                    now, state, size, at, last, problem = upload, hashlib.sha256(), 0, 0, b"", None
                data = data or b""
                if chunk == at - 1:
                    problem = problem if data == last else problem or "conflicting"
                    continue
                if chunk != at:
                    problem = problem or "missing"
                state.update(data)
                size, at, last = size + len(data), chunk + 1, data
            yield _rows(done)
        if now is not None:
            yield _rows([end()])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = zip(*done, strict=True) if done else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _DONE.split(", ")])

    dealt = chunks.select(F.col("upload_id").cast("string").alias("upload_id"), F.col("chunk").cast("int").alias("chunk"), "data")
    return dealt.repartition("upload_id").sortWithinPartitions("upload_id", "chunk").mapInArrow(run, _DONE)


class BlobStore:
    """Blobs below a folder that all executors share, each at ``<two digits>/<hash>/``, as one file.

    ``index`` is a table (blob_hash, byte_size) of what is stored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def stored(self) -> DataFrame:
        """(blob_hash, byte_size, content) of all blobs; a read of names and sizes only leaves the bytes alone."""
        at, fs = hadoop_path(self.spark, f"{self.path}/blobs")
        if not fs.exists(at):
            return self.spark.createDataFrame([], "blob_hash string, byte_size long, content binary")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.blob").load(f"{self.path}/blobs")
        name = F.regexp_extract("path", r"([0-9a-f]{64})\.blob$", 1)
        return files.select(name.alias("blob_hash"), F.col("length").alias("byte_size"), "content")

    def put(self, uploads: DataFrame) -> DataFrame:
        """Store uploads (upload_id, data), or in chunks (with a column chunk); (upload_id, blob_hash, byte_size, problem, outcome) of each.

        outcome is stored (this upload's bytes are now the file), duplicate
        (there before, or brought by another upload) or null with a problem.
        Where a hash is stored its file is read and must have that hash and
        size; if not, CorruptBlob and nothing is written.  Of uploads with one
        hash the least id is stored.  A retried or speculative task writes
        under a name of its own and renames, so a file is whole or absent.
        """
        if "chunk" not in uploads.columns:
            uploads = uploads.withColumn("chunk", F.lit(0))
        seen = checkpoint(digests(uploads))
        wanted = seen.where("blob_hash is not null").groupBy("blob_hash").agg(F.min("upload_id").alias("upload_id"), F.min("byte_size").alias("byte_size"))
        there = self.stored().withColumnsRenamed({"byte_size": "_size"})
        met = wanted.join(there, "blob_hash")
        bad = met.where((F.sha2("content", 256) != F.col("blob_hash")) | (F.col("_size") != F.col("byte_size"))).select("blob_hash").limit(1).collect()
        if bad:
            raise CorruptBlob(f"the stored blob {bad[0][0]} has other bytes")
        new = checkpoint(wanted.join(there.select("blob_hash"), "blob_hash", "left_anti"))
        self._write(uploads.join(new.select("upload_id", "blob_hash"), uploads["upload_id"].cast("string") == new["upload_id"]).select("blob_hash", "chunk", "data"))
        own = new.select("upload_id", F.lit("stored").alias("_o"))
        outcome = F.when(F.col("problem").isNull(), F.coalesce("_o", F.lit("duplicate")))
        return seen.join(own, "upload_id", "left").withColumn("outcome", outcome).drop("_o")

    def _write(self, chunks: DataFrame) -> None:
        """One file a hash: its chunks in order, from the task that has the hash; a file is named when it is whole."""
        staging = f"{self.path}/staging/{uuid.uuid4().hex}"
        # Spark's committer makes the files appear once each, whatever tasks are retried; rows of a hash are one partition folder.
        whole = (
            chunks.groupBy("blob_hash")
            .agg(F.array_sort(F.collect_set(F.struct("chunk", F.coalesce("data", F.lit(b"")).alias("data")))).alias("_c"))  # at most MAX_BYTES
            .select("blob_hash", F.aggregate("_c", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"))
        )
        whole.write.parquet(staging)
        written = self.spark.read.parquet(staging)
        path = self.path

        def install(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _filesystem(path)
            for batch in batches:
                for blob, data in zip(batch["blob_hash"].to_pylist(), batch["data"].to_pylist(), strict=True):
                    folder = f"{root}/blobs/{blob[:FAN_DIGITS]}"
                    fs.create_dir(folder, recursive=True)
                    passing = f"{folder}/.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(passing) as out:
                        out.write(data)
                    fs.move(passing, f"{folder}/{blob}.blob")  # equal bytes, should another attempt have been here
                yield batch.select(["blob_hash"])

        written.mapInArrow(install, "blob_hash string").count()
        remove(self.spark, staging)

    def open(self, attachments: DataFrame, attachment_id) -> bytes:
        """The bytes of a live attachment (attachment_id, blob_hash, deleted_at); KeyError if there is none, CorruptBlob if its blob is missing or wrong."""
        row = attachments.where((F.col("attachment_id") == attachment_id) & F.col("deleted_at").isNull()).select("blob_hash").first()
        if row is None:
            raise KeyError(attachment_id)
        if not row[0] or len(row[0]) != 64 or set(row[0]) - set("0123456789abcdef"):
            raise CorruptBlob(f"{row[0]!r} is no hash")
        at, fs = hadoop_path(self.spark, f"{self.path}/blobs/{row[0][:FAN_DIGITS]}/{row[0]}.blob")
        if not fs.exists(at):
            raise CorruptBlob(f"attachment {attachment_id} references a missing blob")
        found = self.stored().where(F.col("blob_hash") == row[0]).select("content").first()
        if hashlib.sha256(found[0]).hexdigest() != row[0]:
            raise CorruptBlob(f"the stored blob {row[0]} has other bytes")
        return bytes(found[0])

    def missing(self, attachments: DataFrame) -> DataFrame:
        """Live attachments whose blob is not stored."""
        return attachments.where("deleted_at is null").join(self.stored().select("blob_hash"), "blob_hash", "left_anti")

    def verify(self) -> DataFrame:
        """(blob_hash, byte_size) of stored blobs whose bytes have another hash."""
        return self.stored().where(F.sha2("content", 256) != F.col("blob_hash")).select("blob_hash", "byte_size")


def _filesystem(path: str):
    """The Arrow file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

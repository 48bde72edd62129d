"""Exact deduplication by an extendible-hash index on shared files, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster

BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of distinct texts that fill a bucket at most, and the directory's greatest depth: at most 2 ** MAX_DEPTH entries.
#: A small corpus has smaller buckets, a few for each shuffle partition; one that fills all slots has larger ones.
CAPACITY, MAX_DEPTH = 8 << 20, 16
#: A key is hot when over one row in HOT_SHARE has it, so at most HOT_SHARE keys are; their rows are dealt in SALTS shares.
HOT_SHARE, SALTS = 1000, 64


class Index(NamedTuple):
    """rows: (row, id, points, key, sha256, body); directory: (slot, bucket, depth) at the global depth; entries: what the bucket files hold."""

    rows: DataFrame
    directory: DataFrame
    depth: int
    entries: DataFrame


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit key, as an int."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def directory(fill: DataFrame, capacity: int = CAPACITY, parts: int = 1) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) of the global depth, and that depth, for (cell, bytes): the fill of each prefix of MAX_DEPTH bits.

    A bucket is the range of keys that share its depth's bits; overfull ones
    split in two, and the directory doubles while a bucket of the global depth
    is overfull.  bucket is the first cell of the range.  A slot is a prefix of
    the global depth; slots without keys have no row.
    """
    total, cells = fill.agg(F.sum("bytes"), F.count("*")).first()
    capacity = max(min(capacity, (total or 0) // (2 * parts) + 1), 2 * (total or 0) >> MAX_DEPTH)
    depth = min(MAX_DEPTH, max(0, ((total or 0) // capacity).bit_length() - 1))
    at = cluster.checkpoint(fill.withColumn("depth", F.lit(depth)))
    shift = lambda d: F.expr(f"shiftright(cell, {MAX_DEPTH} - {d})")
    while depth < MAX_DEPTH:
        over = at.where(F.col("depth") == depth).groupBy(shift("depth").alias("over")).agg(F.sum("bytes").alias("b")).where(F.col("b") > capacity)
        over = cluster.checkpoint(over.select("over"))
        if over.isEmpty():
            break
        # At most 2 ** MAX_DEPTH rows.
        split = at.join(F.broadcast(over), (F.col("depth") == depth) & (shift("depth") == F.col("over")), "left")
        at = cluster.checkpoint(split.select("cell", "bytes", (F.col("depth") + F.col("over").isNotNull().cast("int")).alias("depth")))
        depth += 1
    bucket = F.expr(f"shiftleft(shiftright(cell, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)")
    return at.select(shift(depth).alias("slot"), bucket.alias("bucket"), "depth").distinct(), depth


def build(
    docs: DataFrame,
    scratch: cluster.Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    key_of: Callable[[Column], Column] = F.xxhash64,
) -> Index:
    """The index of a table's texts: a bucket's files hold its keys' chains, one entry for each different text.

    An entry is (bucket, salt, key, sha256, body, size, best): the normalised
    text, how many rows have it and the one that stays.  Each bucket is one
    task's, which sorts its keys and compares the bytes of texts that share
    one; a hot key's rows are dealt to SALTS tasks first, with an entry each.
    """
    body = F.col("body")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        normalised(F.col(text_col)).alias("body"),
    )
    rows = rows.select("row", "id", "points", key_of(body).alias("key"), F.sha2(body.cast("binary"), 256).alias("sha256"), "body")
    rows = scratch.write(rows, "rows")
    keys = scratch.write(rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("body") + 64).alias("bytes")), "keys")
    fill = keys.groupBy(_prefix(F.col("key"), MAX_DEPTH).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots, depth = directory(cluster.checkpoint(fill), capacity, parts)
    slots = scratch.write(slots.coalesce(1), "directory")
    n_rows, buckets = rows.count(), slots.select("bucket").distinct().count()
    hot = keys.where(F.col("n") > max(1, n_rows // HOT_SHARE)).select("key", F.lit(True).alias("hot"))
    parts = max(parts, buckets)
    dealt = (
        rows.withColumn("slot", _prefix(F.col("key"), depth))
        .join(F.broadcast(slots), "slot")  # at most 2 ** MAX_DEPTH rows
        .join(F.broadcast(hot), "key", "left")  # at most HOT_SHARE rows
        .withColumn("salt", F.when(F.col("hot"), F.pmod("row", F.lit(SALTS)) + 1).otherwise(0).cast("int"))
        .repartition(parts, "bucket", "salt")
    )
    best = F.max(F.struct("points", F.col("id").isNotNull().alias("named"), (-F.col("id")).alias("minus_id"), (-F.col("row")).alias("minus_row"))).alias("best")
    entries = dealt.groupBy("bucket", "salt", "key", "sha256", "body").agg(F.count("*").alias("size"), best)
    return Index(rows, slots, depth, scratch.write(entries, "entries", "bucket"))


def groups(index: Index) -> DataFrame:
    """(key, sha256, size, best) for each different text; the entries of a hot key are joined by their bytes."""
    whole = index.entries.where("salt = 0").select("key", "sha256", "size", "best")
    hot = index.entries.where("salt > 0").groupBy("key", "sha256", "body").agg(F.sum("size").alias("size"), F.max("best").alias("best"))
    return whole.union(hot.select("key", "sha256", "size", "best"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) for each row of docs.

    Rows are equal when their texts are, without blanks; null is an empty
    text, so null, empty and blank texts are one group.  Of a group the row
    with the most code points in its own text stays, then that of the smallest
    id, null ids last; of rows equal in both too, one.  Ids are integers.
    Other columns are not read.  An empty table gives an empty one.

    Plan: one scan writes keys, digests and normalised texts.  The fill of key
    prefixes decides the directory, which is broadcast; texts move once, to
    the task that owns their bucket.  A row finds its entry by key and, within
    the key's chain, by the SHA-256 of the text.  At the end the scratch holds
    small tables only.
    """
    scratch = cluster.Scratch(docs.sparkSession)
    index = build(docs, scratch, id_col, text_col, **options)
    found = scratch.write(groups(index), "groups")
    small = scratch.write(index.rows.select("row", "id", "key", "sha256"), "small")
    scratch.keep_only("groups", "small")
    return small.join(found, ["key", "sha256"]).select(
        F.col("id").alias(id_col),
        (-F.col("best.minus_id")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == -F.col("best.minus_row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )

"""Contiguous shards of near-equal bytes, cut on global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cluster

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id_col, size, text_crc32, shard, slot), in id order cut at equal byte targets.

    size is the text's UTF-8 bytes (null: none) plus 1.  Row order is id, then
    checksum, then size; null ids come first and rows equal in all three are
    interchangeable.  A row goes to the shard in which the middle of its bytes
    falls, so a shard's edge is at most half a row off its target; slot counts
    a shard's rows from 0 without gaps.  An empty table gives an empty one,
    and shards may stay empty where there are fewer rows than shards.

    Only (id, checksum, size) is shuffled, never texts.  Ranges of ids are
    sorted apart; their totals, a row for each range, give the prefix sums.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are found by sampling, so they are settled before two readers rely on them.
    ranged = cluster.checkpoint(
        rows.repartitionByRange(parts, "id", "crc", "size").withColumn("part", F.spark_partition_id())
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("all_bytes"),
    )
    own = Window.partitionBy("part").orderBy("id", "crc", "size")
    placed = (
        ranged.withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(own))
        .join(F.broadcast(totals), "part")  # a row for each partition
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least(middle * {shards} div (2 * all_bytes), {shards - 1}) as int)"))
        .withColumn("nth", F.col("rows_before") + F.col("nth"))
        .select("id", "size", "crc", "shard", "nth")
    )
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row for each shard
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("nth") - F.col("first")).cast("long").alias("slot"),
    )

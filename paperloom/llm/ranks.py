"""Global positions of rows in an order, from ranges that are sorted apart and the totals of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cluster

PART, AT = "_pl_part", "_pl_at"


def numbered(rows: DataFrame, order: list[Column], scratch: cluster.Scratch, name: str, parts: int | None = None) -> DataFrame:
    """rows with _pl_part, the range they fell in, and _pl_at, their place from 0 in the whole order.

    rows should be a written table: ranges are found by sampling it.  Rows
    equal in the order are interchangeable, and split between ranges where
    they are many.  Only totals, a row for each range, meet in one task.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.monotonically_increasing_id()
    dealt = rows.withColumn("_pl_tie", own).repartitionByRange(parts, *order, F.col("_pl_tie"))
    dealt = dealt.sortWithinPartitions(*order, "_pl_tie").drop("_pl_tie").withColumn(AT, own)
    dealt = scratch.write(dealt, name).withColumn(PART, F.shiftright(AT, 33).cast("int"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(PART).count().select(PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_pl_before"))
    place = F.col("_pl_before") + F.col(AT).bitwiseAND(F.lit((1 << 33) - 1))
    # A row for each range.
    return dealt.join(F.broadcast(totals), PART).withColumn(AT, place).drop("_pl_before")

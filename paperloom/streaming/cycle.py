"""The pull cycle: pages of changes are merged into a stored baseline, and the cursor follows.

The baseline is a table of segments (``sources.segments``): a page adds one
small segment with the rows that it changes, and its cursor and batch number
are in the same commit.  So a page that comes again changes nothing, a reader
sees whole pages only, and what is written grows with the page, not with the
baseline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import KEY, apply_changes, baseline
from ..sources.segments import Segments
from ..sources.shared import checkpoint

CHANGE = "sequence long, entity_type string, entity_id string, version long, content_hash string"
#: Segments from which the smaller ones are folded, and the stored row's place before all of a page.
MAX_SEGMENTS, _BEFORE = 16, -(2**63) + 1


def stored(spark: SparkSession, state_path: str, version: int | None = None) -> DataFrame:
    """The baseline of a version, the last by default: a row for each entity."""
    store = Segments(spark, state_path)
    return _latest(store.read("baseline", CHANGE, store.manifest(version)))


def _latest(rows: DataFrame) -> DataFrame:
    return baseline(rows.drop("_segment")).select([f.split()[0] for f in CHANGE.split(", ")])


def acknowledged(spark: SparkSession, state_path: str) -> int | None:
    """The cursor: the greatest sequence that a committed page has brought."""
    return Segments(spark, state_path).manifest()["facts"].get("cursor")


def merge(page: DataFrame, state_path: str, batch: tuple[str, int] | None = None) -> DataFrame:
    """Merge one page into the baseline; returns its changes with their outcome against what was stored before it.

    A page whose batch (source, number) has been committed is judged but not
    merged again, and all of it is ignored or corrupt.  The same version with
    another hash is corrupt and does not enter.  Equal changes of one page
    count once.  Only entities of the page are read, from the row groups that
    may hold them.
    """
    spark = page.sparkSession
    store = Segments(spark, state_path)
    base = store.manifest()
    new = checkpoint(page.select([f.split()[0] for f in CHANGE.split(", ")]).distinct())
    keys = new.select(*KEY).distinct()
    old = _latest(store.read("baseline", CHANGE, base).join(keys, list(KEY), "left_semi"))
    both = old.withColumn("_at", F.lit(_BEFORE)).unionByName(new.withColumn("_at", F.col("sequence")))
    both = both.withColumnsRenamed({"sequence": "_sequence", "_at": "sequence"})
    judged = checkpoint(apply_changes(both))
    kept = baseline(judged.where("outcome = 'applied'").drop("outcome")).where(F.col("sequence") != _BEFORE)
    kept = kept.withColumn("sequence", F.col("_sequence")).drop("_sequence")
    kept = kept.repartitionByRange(*KEY).sortWithinPartitions(*KEY).select([f.split()[0] for f in CHANGE.split(", ")])
    last = new.agg(F.max("sequence")).first()[0]
    known = [c for c in (base["facts"].get("cursor"), last) if c is not None]
    after = store.commit(base, add={"baseline": kept}, facts={"cursor": max(known, default=None)}, batch=batch)
    first = store.foldable(after, "baseline", MAX_SEGMENTS)
    if first is not None:
        whole = _latest(store.read("baseline", CHANGE, after, first))
        store.commit(after, fold={"baseline": (first, whole.repartitionByRange(*KEY).sortWithinPartitions(*KEY))})
    rows = judged.where(F.col("sequence") != _BEFORE)
    return rows.withColumn("sequence", F.col("_sequence")).drop("_sequence")


def follow(
    spark: SparkSession,
    pages: str | DataFrame,
    state_path: str,
    checkpoint_path: str,
    pages_a_run: int = 100,
    on_page: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Merge all pages that are there, each a micro-batch, and stop; a later call goes on after the last committed one.

    pages is a folder with a file for each page, or a stream of changes with a
    page a micro-batch.  ``on_page`` gets each page's judged changes.
    """
    if isinstance(pages, str):
        pages = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(pages)
    left = [pages_a_run]

    def step(page: DataFrame, number: int) -> None:
        if left[0] <= 0:
            raise RuntimeError(f"more than {pages_a_run} pages in one run")
        left[0] -= 1
        judged = merge(page, state_path, (checkpoint_path, number))
        if on_page:
            on_page(judged)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()

"""Paper items: validation, order, numbering and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import content_hash
from ..functions.scalars import QUESTION_TYPES, rank_of


def item_errors(items: DataFrame) -> DataFrame:
    """(paper_id, items, errors) of papers whose items break a rule; items has paper_id, item_order, marks."""
    n = F.count("*")
    checks = {
        "item order must start at 0": F.min("item_order") != 0,
        "item order must be contiguous": F.max("item_order") != n - 1,
        "item order must be unique": F.countDistinct("item_order") != n,
        "marks must be positive": F.coalesce(F.min("marks") <= 0, F.lit(False)),
    }
    found = F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()])
    rows = items.groupBy("paper_id").agg(n.alias("items"), F.filter(found, lambda e: e.isNotNull()).alias("errors"))
    return rows.where(F.size("errors") > 0)


def ordered(items: DataFrame, categorized: bool = False) -> DataFrame:
    """place from 0 in each paper: by item order, or by question type and then item order."""
    by = [rank_of(F.col("question_type"), QUESTION_TYPES)] if categorized else []
    w = Window.partitionBy("paper_id").orderBy(*by, "item_order")
    return items.withColumn("place", F.row_number().over(w) - 1)


def numbered(placed: DataFrame) -> DataFrame:
    """number through the paper, number in the section, and whether a section starts, by place.

    A section is a run of places, so one order serves all: its first place is the last that starts one.
    """
    paper = Window.partitionBy("paper_id").orderBy("place")
    upto = paper.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.lag("question_type").over(paper) != F.col("question_type"), F.lit(True))
    out = placed.withColumn("starts_section", starts)
    out = out.withColumn("section", F.sum(F.col("starts_section").cast("int")).over(upto))
    first = F.max(F.when(F.col("starts_section"), F.col("place"))).over(upto)
    return out.withColumns({"number": F.col("place") + 1, "section_number": F.col("place") - first + 1})


def reorder(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items in a new order (paper_id, item_ids); papers whose ids are no permutation keep theirs."""
    want = orders.select("paper_id", F.posexplode("item_ids").alias("_to", "item_id"))
    have = items.groupBy("paper_id").agg(F.array_sort(F.collect_list("item_id")).alias("_ids"))
    exact = orders.join(have, "paper_id").where(F.array_sort("item_ids") == F.col("_ids")).select("paper_id")
    moves = want.join(exact, "paper_id", "left_semi")
    return items.join(moves, ["paper_id", "item_id"], "left").withColumn("item_order", F.coalesce("_to", "item_order")).drop("_to")


def update_marks(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with new marks (item_id, marks); an id given twice is left alone."""
    once = changes.groupBy("item_id").agg(F.first("marks").alias("_m"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return items.join(once, "item_id", "left").withColumn("marks", F.coalesce("_m", "marks")).drop("_m").select(*items.columns)


def paper_errors(papers: DataFrame, items: DataFrame) -> DataFrame:
    """(paper_id, errors) of papers that break a rule of their own or of their items."""
    rules = {
        "title is required": F.coalesce(F.trim("title"), F.lit("")) != "",
        "title is too long": F.coalesce(F.length("title"), F.lit(0)) <= 200,
        "duration must be positive": F.col("duration_minutes") > 0,
        "total marks must be positive": F.col("total_marks") > 0,
    }
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(t)) for t, ok in rules.items()]), lambda e: e.isNotNull())
    own = papers.select("paper_id", found.alias("_own"))
    joined = own.join(item_errors(items).select("paper_id", F.col("errors").alias("_items")), "paper_id", "left")
    errors = F.concat("_own", F.coalesce("_items", F.array().cast("array<string>")))
    return joined.select("paper_id", errors.alias("errors")).where(F.size("errors") > 0)


#: What a paper's hash covers; times, version and owner are left out.
HASHED = ("title", "subject", "duration_minutes", "total_marks", "items")


def hydrated(papers: DataFrame, items: DataFrame, *fields: str) -> DataFrame:
    """Papers with items, an array of structs (item_order and the fields) in order; empty for none."""
    kind = "array<struct<" + ",".join(f"{f}:{dict(items.dtypes)[f]}" for f in ("item_order", *fields)) + ">>"
    own = items.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("item_order", *fields))).alias("items"))
    return papers.join(own, "paper_id", "left").withColumn("items", F.coalesce("items", F.array().cast(kind)))


def with_hash(whole: DataFrame) -> DataFrame:
    """Hydrated papers with content_hash."""
    return whole.withColumn("content_hash", content_hash("paper", 1, F.struct(*HASHED)))


def corrupt(whole: DataFrame, stored: DataFrame) -> DataFrame:
    """Hydrated papers whose stored hash (paper_id, content_hash) is another."""
    found = with_hash(whole).select("paper_id", F.col("content_hash").alias("found_hash"))
    return stored.join(found, "paper_id").where("content_hash <> found_hash")


def created(candidates: DataFrame, now: int) -> DataFrame:
    """New papers: version 1, both times now, no deletion and an own hash, whatever the caller gave; items in order."""
    stamped = candidates.withColumns(
        {
            "items": F.array_sort("items"),
            "version": F.lit(1).cast("long"),
            "created_at": F.lit(now).cast("long"),
            "updated_at": F.lit(now).cast("long"),
            "deleted_at": F.lit(None).cast("long"),
        }
    )
    return with_hash(stamped)


def replaced(items: DataFrame, updated: DataFrame) -> DataFrame:
    """Items with those of the updated papers in place of their old ones."""
    papers = updated.select("paper_id").distinct()
    return items.join(papers, "paper_id", "left_anti").unionByName(updated.select(*items.columns))


def totals(items: DataFrame) -> DataFrame:
    return items.groupBy("paper_id").agg(F.count("*").alias("items"), F.sum("marks").alias("total_marks"))

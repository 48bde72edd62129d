"""The driver's tables read as question-bank tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types as mutation kinds and queue states (fixed values).
KINDS = {"signup": "create", "click": "update", "view": "update", "error": "delete", "purchase": "restore"}
STATES = {"signup": "pending", "click": "retrying", "view": "settled", "error": "failed", "purchase": "conflict"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by(col: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for a, b in names.items():
        out = F.when(col == a, b).otherwise(out)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions: six kinds of part for six types, brand as subject, name as tags, size as difficulty."""
    types = {
        "ECONOMY": "single_choice", "LARGE": "multiple_choice", "MEDIUM": "true_false",
        "PROMO": "blank", "SMALL": "short_answer", "STANDARD": "essay",
    }
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("text"),
        _by(F.col("p_type"), types).alias("type"),
        F.array("p_brand").alias("subjects"),
        F.split("p_name", " ").alias("tags"),
        F.when(F.col("p_size") <= 16, "easy").when(F.col("p_size") <= 33, "medium").otherwise("hard").alias("difficulty"),
        (F.col("p_retailprice") / 1000).alias("weight"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operation log: a user is an entity, an event an operation."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("op_id"),
        F.col("user_id").alias("entity_id"),
        F.col("ts").alias("changed_at"),
        _by(F.col("event_type"), KINDS).alias("kind"),
        _by(F.col("event_type"), STATES).alias("state"),
        F.col("props").alias("payload"),
        F.sha2("props", 256).alias("content_hash"),
        "value",
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = log(spark, sf_dir)
    from ..operators.versions import number

    return number(w, "entity_id", "changed_at", "op_id")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as an outgoing queue."""
    w = log(spark, sf_dir)
    micros = F.unix_micros(F.col("changed_at").cast("timestamp"))
    return w.select(
        F.col("op_id").alias("operation_id"), "entity_id", "state", F.col("changed_at").alias("created_at"),
        F.col("changed_at").alias("updated_at"), F.col("content_hash").alias("payload_hash"),
        F.when(F.col("state") == "failed", F.concat(F.lit("E_"), (F.col("op_id") % 7).cast("string"))).alias("error_code"),
        F.when(F.col("op_id") % 3 == 0, F.lit("owner")).alias("owner_id"),
        F.when(F.col("op_id") % 5 == 0, F.lit("batch")).alias("batch_id"),
        F.when(F.col("op_id") % 4 == 0, micros).alias("due_at"),
        (F.col("op_id") % 11 + 1).alias("attempts"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as paper items."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"),
        (F.col("l_linenumber") - 1).alias("item_order"),
        F.col("l_quantity").alias("marks"),
        F.col("l_partkey").alias("question_id"),
        F.col("l_extendedprice").alias("price"),
    )

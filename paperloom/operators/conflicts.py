"""Stored conflicts and their resolutions, as windows over the decisions of each conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a conflict may be about, and why (fixed values).
ENTITIES = ("question", "paper", "draft", "attachment", "comment", "favorite", "setting")
REASONS = ("concurrentCreate", "divergentContent", "tombstoneDivergence", "restoreDivergence", "renameDivergence")
_HASH = "^[0-9a-f]{64}$"
_SNAPSHOT = ("account_id", "base_version", "base_hash", "base", "local", "cloud_version", "cloud_hash", "cloud", "reason")


def conflict_errors(conflicts: DataFrame) -> DataFrame:
    """Conflicts with an errors list; a base is there just when the reason is not a concurrent creation."""
    has_base = F.col("base_version").isNotNull() & F.col("base_hash").isNotNull()
    no_base = F.col("base_version").isNull() & F.col("base_hash").isNull()
    rules = {
        "entityType is unsupported": F.col("entity_type").isin(*ENTITIES),
        "reason is unsupported": F.col("reason").isin(*REASONS),
        "local snapshot is required": F.col("local").isNotNull(),
        "cloud snapshot is required": F.col("cloud").isNotNull(),
        "cloud version is invalid": F.col("cloud_version") >= 1,
        "cloud contentHash is invalid": F.col("cloud_hash").rlike(_HASH),
        "base contentHash is invalid": F.col("base_hash").isNull() | F.col("base_hash").rlike(_HASH),
        "baseline does not match its reason": F.when(F.col("reason") == "concurrentCreate", no_base).otherwise(has_base),
    }
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in rules.items()])
    return conflicts.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def store(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Conflicts by id with what came last for each (by received_at, then cloud_version).

    A known conflict keeps its operation, its creation and how far it is
    resolved; a new one is unresolved.  Either has all snapshots afterwards.
    """
    last = incoming.groupBy("conflict_id").agg(
        F.max_by(F.struct(*_SNAPSHOT, "entity_type", "entity_id", "received_at"), F.struct("received_at", "cloud_version")).alias("_n")
    )
    joined = stored.withColumn("_s", F.struct(*stored.columns)).select("conflict_id", "_s").join(last, "conflict_id", "full_outer")
    fresh = F.col("_n").isNotNull()
    pick = lambda name: F.when(fresh, F.col(f"_n.{name}")).otherwise(F.col(f"_s.{name}")).alias(name)
    return joined.select(
        "conflict_id",
        *[pick(n) for n in _SNAPSHOT],
        *[F.coalesce(f"_s.{n}", f"_n.{n}").alias(n) for n in ("entity_type", "entity_id")],
        F.col("_s.operation_id").alias("operation_id"),
        F.when(fresh, "complete").otherwise(F.col("_s.hydration")).alias("hydration"),
        F.coalesce("_s.resolution_state", F.lit("unresolved")).alias("resolution_state"),
        F.coalesce("_s.created_at", "_n.received_at").alias("created_at"),
        F.coalesce("_n.received_at", "_s.updated_at").alias("updated_at"),
    )


EVENT = ("conflict_id", "seq", "kind", "operation_id", "action", "version", "content_hash", "request_hash", "response_hash", "accepted_version", "accepted_hash")


def resolve(conflicts: DataFrame, events: DataFrame) -> DataFrame:
    """Events with their outcome and the conflict's state, cloud_version and cloud_hash after all of its events.

    conflicts: conflict_id, cloud_version, cloud_hash, hydration, all
    unresolved.  events (``EVENT``), ordered by the unique seq: a ``stage`` asks
    for an action on the version and hash that its user saw, a ``settle``
    brings the answer to an operation.  An operation is of one conflict.

    A conflict takes one resolution and, once that is settled, one undo of it;
    so the first fitting stage, its first fitting answer, the first fitting
    undo and its answer decide all other outcomes.  A stage is staged,
    existing (the same request again), rejected (another request under its
    operation), notReady, stale, unavailable or notFound; a settle is
    accepted, replayed, corrupt (another answer to an accepted operation),
    rejected or notFound.  saveCopy leaves the cloud side as it was.
    """
    w = Window.partitionBy("conflict_id")
    e = events.select(*EVENT).join(
        conflicts.select("conflict_id", F.col("cloud_version").alias("v0"), F.col("cloud_hash").alias("h0"), "hydration"), "conflict_id", "left"
    )
    stage, undo = F.col("kind") == "stage", F.col("action") == "undo"
    ready = F.coalesce(F.col("hydration") == "complete", F.lit(False))
    first = lambda ok, *of: F.min(F.when(F.coalesce(ok, F.lit(False)), F.struct("seq", *of))).over(w)
    sees = lambda v, h: F.col("version").eqNullSafe(F.col(v)) & F.col("content_hash").eqNullSafe(F.col(h))
    request = ("operation_id", "action", "request_hash")
    answer = ("response_hash", "accepted_version", "accepted_hash")

    def answers(op: str) -> Column:
        return (F.col("kind") == "settle") & (F.col("seq") > F.col(f"{op}.seq")) & (F.col("operation_id") == F.col(f"{op}.operation_id")) & (F.col("action") == F.col(f"{op}.action"))

    e = e.withColumn("s1", first(stage & ~undo & ready & sees("v0", "h0"), *request))
    e = e.withColumn("t1", first(answers("s1"), *answer))
    moved = F.col("t1").isNotNull() & (F.col("s1.action") != "saveCopy")
    e = e.withColumns({"v1": F.when(moved, F.col("t1.accepted_version")).otherwise(F.col("v0")), "h1": F.when(moved, F.col("t1.accepted_hash")).otherwise(F.col("h0"))})
    other = F.col("operation_id") != F.col("s1.operation_id")
    e = e.withColumn("s2", first(stage & undo & other & (F.col("seq") > F.col("t1.seq")) & sees("v1", "h1"), *request))
    e = e.withColumn("t2", first(answers("s2"), *answer))
    after = lambda x: F.coalesce(F.col("seq") > F.col(f"{x}.seq"), F.lit(False))
    is_at = lambda x: F.coalesce(F.col("seq") == F.col(f"{x}.seq"), F.lit(False))
    now = F.when(after("t2"), F.struct(F.col("t2.accepted_version").alias("v"), F.col("t2.accepted_hash").alias("h")))
    now = now.when(after("t1"), F.struct(F.col("v1").alias("v"), F.col("h1").alias("h"))).otherwise(F.struct(F.col("v0").alias("v"), F.col("h0").alias("h")))
    again = lambda x: after(x) & (F.col("operation_id") == F.col(f"{x}.operation_id"))
    same = lambda x: F.when(F.col("request_hash") == F.col(f"{x}.request_hash"), "existing").otherwise("rejected")
    staged = (
        F.when(F.col("v0").isNull(), "notFound")
        .when(is_at("s1") | is_at("s2"), "staged")
        .when(again("s1"), same("s1"))
        .when(again("s2"), same("s2"))
        .when(~ready, "notReady")
        .when(~(F.col("version").eqNullSafe(now["v"]) & F.col("content_hash").eqNullSafe(now["h"])), "stale")
        .otherwise("unavailable")
    )

    def settled(s: str, t: str) -> Column:
        replay = F.when(F.col("response_hash").eqNullSafe(F.col(f"{t}.response_hash")), "replayed").otherwise("corrupt")
        return F.when(is_at(t), "accepted").when(after(t), replay).otherwise("rejected")

    outcome = F.when(stage, staged).otherwise(
        F.when(again("s1"), settled("s1", "t1")).when(again("s2"), settled("s2", "t2")).otherwise("notFound")
    )
    state = (
        F.when(F.col("t2").isNotNull(), "undone")
        .when(F.col("s2").isNotNull(), "resolving")
        .when(F.col("t1").isNotNull(), "resolved")
        .when(F.col("s1").isNotNull(), "resolving")
        .otherwise("unresolved")
    )
    return e.select(
        *EVENT,
        outcome.alias("outcome"),
        state.alias("state"),
        F.coalesce("t2.accepted_version", "v1").alias("cloud_version"),
        F.coalesce("t2.accepted_hash", "h1").alias("cloud_hash"),
    )


def listed(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Conflicts with their accepted resolutions in order, as an array; unresolved ones first, then resolving ones, the newest first."""
    accepted = (
        resolutions.where("state = 'accepted'")
        .groupBy("conflict_id")
        .agg(F.array_sort(F.collect_list(F.struct("created_at", "operation_id", "action"))).alias("resolutions"))
    )
    none = F.array().cast("array<struct<created_at:bigint,operation_id:bigint,action:string>>")
    rank = F.when(F.col("resolution_state") == "unresolved", 0).when(F.col("resolution_state") == "resolving", 1).otherwise(2)
    joined = conflicts.join(accepted, "conflict_id", "left").withColumn("resolutions", F.coalesce("resolutions", none))
    return joined.orderBy(rank, F.desc("updated_at"), "conflict_id")


def next_resolution(resolutions: DataFrame) -> DataFrame:
    """The pending resolution to send next: one row, or none."""
    return resolutions.where("state = 'pending'").orderBy("created_at", "operation_id").limit(1)

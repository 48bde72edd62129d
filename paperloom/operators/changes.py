"""Ordered change logs: idempotent apply, baselines, conflicts and field differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("entity_type", "entity_id")


def change_errors(changes: DataFrame) -> DataFrame:
    """Changes with an errors list: version, hash and kind rules of the envelope."""
    rules = {
        "version must be positive": F.coalesce(F.col("version") < 1, F.lit(True)),
        "contentHash must be 64 lowercase hex digits": ~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "entityId is required": F.coalesce(F.col("entity_id").cast("string"), F.lit("")) == "",
    }
    found = F.array(*[F.when(bad, F.lit(text)) for text, bad in rules.items()])
    return changes.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def apply_changes(changes: DataFrame, *key: str) -> DataFrame:
    """outcome of each change in sequence order: applied, ignored or corrupt.

    The baseline of a key is its highest version so far, with the hash of the
    first change that brought it.  Older versions and the same version with
    the same hash are ignored; the same version with another hash is corrupt.
    """
    before = Window.partitionBy(*(key or KEY)).orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    base = F.max(F.struct("version", (-F.col("sequence")).alias("first"), "content_hash")).over(before)
    outcome = (
        F.when(F.col("_base").isNull() | (F.col("version") > F.col("_base.version")), "applied")
        .when((F.col("version") == F.col("_base.version")) & (F.col("content_hash") != F.col("_base.content_hash")), "corrupt")
        .otherwise("ignored")
    )
    return changes.withColumn("_base", base).withColumn("outcome", outcome).drop("_base")


def baseline(changes: DataFrame, *key: str) -> DataFrame:
    """The latest accepted change of each key."""
    key = key or KEY
    rest = [c for c in changes.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct("version", (-F.col("sequence")).alias("first"))).alias("_r")
    return changes.groupBy(*key).agg(best).select(*key, "_r.*")


def pending_conflicts(changes: DataFrame, queue: DataFrame, *key: str) -> DataFrame:
    """Applied changes beside the latest unsettled local operation of their key: conflict or settle."""
    key = key or KEY
    latest = (
        queue.where(F.col("state") != "settled")
        .groupBy(*key)
        .agg(F.max_by(F.struct("operation_id", "payload_hash"), F.struct("created_at", "operation_id")).alias("_l"))
        .select(*key, "_l.operation_id", "_l.payload_hash")
    )
    decision = F.when(F.col("payload_hash") == F.col("content_hash"), "settle").otherwise("conflict")
    return changes.where("outcome = 'applied'").join(latest, list(key)).withColumn("decision", decision)


def conflict_reason(local_kind: Column, cloud_kind: Column, local_hash: Column, cloud_hash: Column) -> Column:
    """Why two sides conflict; null when their hashes agree."""
    either = lambda kind: (local_kind == kind) | (cloud_kind == kind)
    return (
        F.when(local_hash == cloud_hash, None)
        .when((local_kind == "create") & (cloud_kind == "create"), "concurrentCreate")
        .when(either("delete"), "tombstoneDivergence")
        .when(either("restore"), "restoreDivergence")
        .when(either("rename"), "renameDivergence")
        .otherwise("divergentContent")
    )


def field_changes(rows: DataFrame, base: str, local: str, cloud: str) -> DataFrame:
    """A row for each field of three string maps, with its change; a missing field is null."""
    maps = [F.coalesce(F.col(c), F.create_map().cast("map<string,string>")) for c in (base, local, cloud)]
    fields = F.array_sort(F.array_distinct(F.concat(*[F.map_keys(m) for m in maps])))
    out = rows.withColumn("field", F.explode(fields))
    b, x, y = (F.element_at(m, F.col("field")) for m in maps)
    change = (
        F.when(b.eqNullSafe(x) & b.eqNullSafe(y), "unchanged")
        .when(~b.eqNullSafe(x) & b.eqNullSafe(y), "localOnly")
        .when(b.eqNullSafe(x) & ~b.eqNullSafe(y), "cloudOnly")
        .when(x.eqNullSafe(y), "sameChange")
        .otherwise("diverged")
    )
    return out.withColumns({"base_value": b, "local_value": x, "cloud_value": y, "change": change})


def resolution_errors(action: Column, has_payload: Column, has_undo: Column) -> Column:
    """What a resolution request breaks; null when it is allowed."""
    return (
        F.when(~action.isin("keepLocal", "keepCloud", "merge", "saveCopy", "undo"), "unknown action")
        .when(action.isin("merge", "saveCopy") & ~has_payload, "payload is required")
        .when(action.isin("keepLocal", "keepCloud", "undo") & has_payload, "payload is not allowed")
        .when((action == "undo") & ~has_undo, "the resolution to undo is required")
        .when((action != "undo") & has_undo, "only undo names another resolution")
    )


def replace_snapshot(baselines: DataFrame, pages: DataFrame, account: str) -> DataFrame:
    """Baselines with one account's rows replaced by its staged pages, the last write of a key winning."""
    staged = pages.where(F.col("account_id") == account)
    rest = [c for c in baselines.columns if c not in KEY]
    last = staged.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("page", "ordinal")).alias("_r"))
    return baselines.where(F.col("account_id") != account).unionByName(last.select(*KEY, "_r.*"))

"""Versioned entities on an append-only history: as-of, tombstones, revert and the operation fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpoint

#: History rows: entity_id, version, kind, content_hash, changed_at and anything else.
ALIVE = ("create", "update", "restore", "revert")


def number(ops: DataFrame, key: str = "entity_id", *order: str) -> DataFrame:
    """Versions 1, 2, ... of each entity in the given order, which must end in a unique column."""
    return ops.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def current(history: DataFrame, key: str = "entity_id", deleted: str = "exclude") -> DataFrame:
    """The latest row of each entity; tombstones by the deleted filter (exclude, include, only)."""
    last = history.groupBy(key).agg(F.max_by(F.struct(*[c for c in history.columns if c != key]), "version").alias("_r"))
    rows = last.select(key, "_r.*")
    if deleted == "include":
        return rows
    return rows.where(F.col("kind") == "delete") if deleted == "only" else rows.where(F.col("kind") != "delete")


def at_version(history: DataFrame, version: int) -> DataFrame:
    return history.where(F.col("version") == version)


def decoded(rows: DataFrame, **kinds: str) -> DataFrame:
    """Rows with their columns ``<name>_json`` parsed as the kinds say; text that is no such JSON is null."""
    out = rows.withColumns({name: F.from_json(f"{name}_json", kind) for name, kind in kinds.items()})
    return out.drop(*[f"{name}_json" for name in kinds])


def get(history: DataFrame, entity_id, key: str = "entity_id") -> DataFrame:
    """The latest row of one entity, a tombstone too; no row means that it never was."""
    return current(history.where(F.col(key) == F.lit(entity_id)), key, "include")


def matches(base_version: Column, base_hash: Column, version: Column, content_hash: Column) -> Column:
    """The optimistic lock: a candidate's base is the current version and hash."""
    return F.coalesce((base_version == version) & (base_hash == content_hash), F.lit(False))


def accept(current_rows: DataFrame, candidates: DataFrame, fixed: tuple[str, ...] = (), key: str = "entity_id") -> DataFrame:
    """Candidates (one an entity) with an outcome: missing, stale, deleted, rejected, unchanged or applied.

    Candidates have the key, base_version, base_hash, content_hash and the
    ``fixed`` columns, which may not differ from the current row's.  An applied
    candidate has the next version as new_version; stale ones are the side
    table of preserved candidates (``preserved``).
    """
    now = current_rows.select(
        key, F.col("version").alias("_v"), F.col("content_hash").alias("_h"), (F.col("kind") == "delete").alias("_d"), *[F.col(c).alias(f"_f_{c}") for c in fixed]
    )
    joined = candidates.join(now, key, "left")
    same = F.lit(True)
    for c in fixed:
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    outcome = (
        F.when(F.col("_v").isNull(), "missing")
        .when(~matches(F.col("base_version"), F.col("base_hash"), F.col("_v"), F.col("_h")), "stale")
        .when(F.col("_d"), "deleted")
        .when(~same, "rejected")
        .when(F.col("content_hash") == F.col("_h"), "unchanged")
        .otherwise("applied")
    )
    out = joined.withColumn("outcome", outcome).withColumn("new_version", F.when(F.col("outcome") == "applied", F.col("_v") + 1))
    return out.withColumnsRenamed({"_v": "current_version", "_h": "current_hash"}).drop("_d", *[f"_f_{c}" for c in fixed])


def preserved(accepted: DataFrame) -> DataFrame:
    """Candidates on an old base, kept with the version and hash that they missed."""
    return accepted.where("outcome = 'stale'").drop("outcome", "new_version")


def as_of(history: DataFrame, moment, key: str = "entity_id", time_col: str = "changed_at") -> DataFrame:
    """The latest row of each entity changed at or before a moment."""
    return current(history.where(F.col(time_col) <= F.lit(moment)), key, "include")


def silent_resurrections(history: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows that follow a tombstone of their entity without restoring it."""
    w = Window.partitionBy(key).orderBy("version")
    return history.withColumn("previous_kind", F.lag("kind").over(w)).where(
        (F.col("previous_kind") == "delete") & ~F.col("kind").isin("restore", "delete")
    )


def revert_targets(history: DataFrame, requests: DataFrame, key: str = "entity_id") -> DataFrame:
    """For requests (key, to_version): outcome revert with the next version, unchanged, or missing."""
    latest = current(history, key, "include").select(
        key, F.col("version").alias("current_version"), F.col("content_hash").alias("current_hash")
    )
    wanted = history.select(key, F.col("version").alias("to_version"), F.col("content_hash").alias("target_hash"))
    joined = requests.join(latest, key, "left").join(wanted, [key, "to_version"], "left")
    outcome = (
        F.when(F.col("target_hash").isNull(), "missing")
        .when(F.col("target_hash") == F.col("current_hash"), "unchanged")
        .otherwise("revert")
    )
    return joined.select(
        key,
        "to_version",
        outcome.alias("outcome"),
        F.when(outcome == "revert", F.col("current_version") + 1).alias("new_version"),
    )


def fold(ops: DataFrame) -> DataFrame:
    """Outcome of each operation on its entity, in op_id order, from an empty store.

    ops: entity_id, op_id, kind (create, update, delete, restore, revert),
    base_version, base_hash (both null: whatever is current), content_hash and
    to_version (revert).  Outcomes: applied, unchanged (same hash, deleting a
    tombstone, restoring what lives), stale (the base is not current),
    rejected (create of what exists, anything else before a create, updating
    or reverting a tombstone, reverting to an unknown version).  Deletion and
    restoration keep the hash and raise the version.

    Operations without a base, other than reverts, depend only on the latest
    create, update, deletion or restoration before them: windows tell that.
    Entities that have a based operation or a revert run as a state machine
    over ranges of their operations (``_based_fold``).
    """
    needed = ("entity_id", "op_id", "kind", "base_version", "base_hash", "content_hash", "to_version")
    ops = ops.select(*needed)
    w = Window.partitionBy("entity_id")
    based = F.col("base_version").isNotNull() | F.col("base_hash").isNotNull() | ~F.col("kind").isin("create", "update", "delete", "restore")
    marked = ops.withColumn("_m", F.max(based).over(w))
    return _free_fold(marked.where("not _m").drop("_m")).unionByName(_based_fold(marked.where("_m").drop("_m")))


def _free_fold(ops: DataFrame) -> DataFrame:
    """``fold`` for entities whose operations have no base and are no reverts."""
    whole = Window.partitionBy("entity_id")
    upto = Window.partitionBy("entity_id").orderBy("op_id").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    o = ops.withColumn("_first", F.min(F.when(kind == "create", F.col("op_id"))).over(whole))
    lives = F.coalesce(F.col("op_id") > F.col("_first"), F.lit(False))
    o = o.withColumns({"_lives": lives, "_is_first": F.coalesce(F.col("op_id") == F.col("_first"), F.lit(False))})
    turn = F.when(F.col("_lives") & kind.isin("delete", "restore"), kind == "delete")
    o = o.withColumn("_gone", F.coalesce(F.last(turn, ignorenulls=True).over(before), F.lit(False)))
    writes = F.col("_is_first") | (F.col("_lives") & (kind == "update") & ~F.col("_gone") & F.col("content_hash").isNotNull())
    o = o.withColumn("_w", F.when(writes, F.struct(F.col("content_hash").alias("h"))))
    o = o.withColumn("_old", F.last("_w", ignorenulls=True).over(before)["h"])
    outcome = (
        F.when(F.col("_is_first"), "applied")
        .when((kind == "create") | ~F.col("_lives"), "rejected")
        .when(kind == "delete", F.when(F.col("_gone"), "unchanged").otherwise("applied"))
        .when(kind == "restore", F.when(F.col("_gone"), "applied").otherwise("unchanged"))
        .when(F.col("_gone") | F.col("content_hash").isNull(), "rejected")
        .when(F.col("content_hash").eqNullSafe(F.col("_old")), "unchanged")
        .otherwise("applied")
    )
    o = o.withColumn("outcome", outcome)
    return o.select(
        "entity_id",
        "op_id",
        "outcome",
        F.sum((F.col("outcome") == "applied").cast("long")).over(upto).alias("version"),
        F.last("_w", ignorenulls=True).over(upto)["h"].alias("content_hash"),
        F.when(F.col("_lives") & kind.isin("delete", "restore"), kind == "delete").otherwise(F.col("_gone")).alias("deleted"),
    )


_RESULT = "part long, entity_id long, op_id long, outcome string, version long, content_hash string, deleted boolean"
#: Bases of a range's first based operations that are tried as the state it starts from, and rows of each trial.
TRIALS, TRIAL_ROWS = 16, 256
#: A range is one group in Python; its rows are 2 ** RANGE_BITS at most, however large a partition is.
RANGE_BITS = 17


def _run(rows: list, start: tuple, looked_up: dict) -> list[tuple]:
    """Outcomes of one entity's operations from a state (version, hash, deleted); looked_up: hashes of earlier versions by op_id."""
    (version, now, deleted), past, out = start, {}, []
    first = version
    for r in rows:
        outcome, new_hash = "applied", now
        based = r.base_version is None and r.base_hash is None or (r.base_version == version and r.base_hash == now)
        if r.kind == "create":
            outcome, new_hash = ("rejected", now) if version else ("applied", r.content_hash)
        elif not version:
            outcome = "rejected"
        elif r.kind == "delete" and deleted or r.kind == "restore" and not deleted:
            outcome = "unchanged"
        elif not based:
            outcome = "stale"
        elif r.kind in ("update", "revert"):
            known = r.content_hash if r.kind == "update" else past.get(r.to_version) if (r.to_version or 0) > first else looked_up.get(r.op_id)
            if deleted or known is None:
                outcome = "rejected"
            elif known == now:
                outcome = "unchanged"
            else:
                new_hash = known
        if outcome == "applied":
            version, now = version + 1, new_hash
            past[version] = now
            deleted = r.kind == "delete" or deleted and r.kind != "restore"
        out.append((r.entity_id, r.op_id, outcome, version, now, deleted))
    return out


def _guess(rows: list) -> tuple:
    """A likely state before operations: the base of one of the first based ones, under which most of the first rows apply."""
    based = [r for r in rows[:TRIAL_ROWS] if r.base_version is not None][:TRIALS]
    tried = {(r.base_version, r.base_hash, r.kind == "restore") for r in based} or {(0, None, False)}
    return max(tried, key=lambda s: (sum(x[2] == "applied" for x in _run(rows[:TRIAL_ROWS], s, {})), s[0]))


def _part(key, ops: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    """One range: the state that it started from (a row without op_id), and its operations' outcomes."""
    ops = ops.sort_values(["entity_id", "op_id"]).astype(object).where(lambda x: x.notna(), None)
    states = given[given["what"] != "past"]
    looked_up = {int(i): h for i, h in zip(given["op_id"], given["content_hash"], strict=True) if not pd.isna(i)}
    out = []
    for n, (_, own) in enumerate(ops.groupby("entity_id", sort=False)):
        rows, start = list(own.itertuples(index=False)), (0, None, False)
        if n == 0 and len(states):
            s = states.iloc[0]
            start = _guess(rows) if s["what"] == "guess" else (int(s["version"]), None if pd.isna(s["content_hash"]) else s["content_hash"], bool(s["deleted"]))
            out.append((rows[0].entity_id, None, None, *start))
        out += _run(rows, start, looked_up if n == 0 else {})
    made = pd.DataFrame(out, columns=["entity_id", "op_id", "outcome", "version", "content_hash", "deleted"])
    made.insert(0, "part", key[0])
    return made.astype({"op_id": "Int64"})


def _based_fold(ops: DataFrame) -> DataFrame:
    """``fold`` as a state machine over ranges of (entity_id, op_id), so that one entity's operations spread over tasks.

    A range that starts within an entity needs the state that the range before
    leaves.  All ranges run at once from a likely state, then those again, and
    only those, whose start was not what the range before has left, or for
    which a reverted version's hash has changed, until none is left: after n
    rounds the first n ranges of an entity are exact, whatever was guessed.
    Where bases mostly name what was current, the guesses are right and two or
    three rounds suffice.
    """
    # A row's number in its sorted partition cuts the partition into ranges of at most 2 ** RANGE_BITS operations.
    sorted_ = ops.repartitionByRange("entity_id", "op_id").sortWithinPartitions("entity_id", "op_id")
    ranged = checkpoint(sorted_.withColumn("part", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)))
    by_part = Window.orderBy("part")  # a row for each range
    spans = ranged.groupBy("part").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_last"))
    spans = checkpoint(spans.withColumn("crossing", F.coalesce(F.col("entity_id") == F.lag("_last").over(by_part), F.lit(False))))
    crossing = spans.where("crossing").select("part", "entity_id")
    blank = {"op_id": "long", "version": "long", "content_hash": "string", "deleted": "boolean"}
    fill = lambda df, what: df.select(F.col("part").alias("part"), F.lit(what).alias("what"), *[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in blank.items()])

    def run(some: DataFrame, given: DataFrame) -> DataFrame:
        return some.groupBy("part").cogroup(given.groupBy("part")).applyInPandas(_part, _RESULT)

    reverts = ranged.where("kind = 'revert'").join(crossing, ["part", "entity_id"]).select("part", "entity_id", F.col("op_id").alias("_op"), F.col("to_version").alias("version"))
    results = checkpoint(run(ranged, fill(crossing, "guess")))
    state = F.struct("version", "content_hash", "deleted")
    seen = None
    while True:
        done = results.where("op_id is not null")
        edges = done.groupBy("part").agg(F.max_by(state, F.struct("entity_id", "op_id")).alias("_left"))
        start = spans.join(edges, "part").withColumn("_now", F.lag("_left").over(by_part)).where("crossing").select("part", "_now")
        used = results.where("op_id is null").select("part", state.alias("_used"))
        past = done.where("outcome = 'applied'").select("entity_id", "version", "content_hash", "op_id")
        past = checkpoint(reverts.join(past, ["entity_id", "version"]).where("op_id < _op").select("part", F.col("_op").alias("op_id"), "content_hash"))
        digest = past.groupBy("part").agg(F.sum(F.xxhash64("op_id", "content_hash").cast("decimal(38,0)")).alias("_digest"))
        before = digest.where(F.lit(False)) if seen is None else seen
        changed = digest.withColumnRenamed("_digest", "_d").join(before, "part", "full_outer").where(~F.col("_d").eqNullSafe(F.col("_digest"))).select("part")
        dirty = checkpoint(start.join(used, "part").where(~F.col("_now").eqNullSafe(F.col("_used"))).select("part").union(changed).distinct())
        if dirty.isEmpty():
            return done.drop("part")
        seen = checkpoint(digest)
        given = fill(start.select("part", "_now.*"), "state").union(fill(past, "past"))
        again = run(ranged.join(dirty, "part", "left_semi"), given.join(dirty, "part", "left_semi"))
        results = checkpoint(results.join(dirty, "part", "left_anti").unionByName(again))


def cascade(deletions: DataFrame, attachments: DataFrame) -> DataFrame:
    """Live attachments of deleted owners, tombstoned at the owner's deletion with a raised version."""
    d = deletions.select(F.col("entity_id").alias("owner_id"), F.col("changed_at").alias("_at"))
    return (
        attachments.where("deleted_at is null")
        .join(d, "owner_id")
        .withColumns({"deleted_at": F.col("_at"), "version": F.col("version") + 1})
        .select(*attachments.columns)
    )

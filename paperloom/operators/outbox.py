"""The outgoing mutation queue: eligibility, batches, version chains, settlement and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import backoff_micros

BATCH = 100


def eligible(queue: DataFrame, owner: str, now: int, limit: int = BATCH) -> DataFrame:
    """The next unbatched operations that are due, oldest first."""
    return (
        queue.where(
            F.col("state").isin("pending", "retrying")
            & F.col("batch_id").isNull()
            & (F.col("owner_id").isNull() | (F.col("owner_id") == owner))
            & (F.col("due_at").isNull() | (F.col("due_at") <= now))
        )
        .orderBy("created_at", "operation_id")
        .limit(limit)
    )


def ordinals(queue: DataFrame, *batch: str) -> DataFrame:
    """batch_ordinal from 0 in queue order within each batch."""
    w = Window.partitionBy(*batch).orderBy("created_at", "operation_id")
    return queue.withColumn("batch_ordinal", F.row_number().over(w) - 1)


def chain(batch: DataFrame, baselines: DataFrame, *key: str) -> DataFrame:
    """Bases for a batch: an entity's first operation takes the remote baseline, later ones the one before.

    Adds base_version, base_hash, predicted_version and depends_on.
    """
    w = Window.partitionBy(*key).orderBy("batch_ordinal")
    base = baselines.select(*key, F.col("version").alias("_v"), F.col("content_hash").alias("_h"))
    first = F.row_number().over(w)
    out = batch.join(base, list(key), "left").withColumn("_n", first)
    start = F.coalesce("_v", F.lit(0))
    return out.withColumns(
        {
            "base_version": F.when((F.col("_n") > 1) | F.col("_v").isNotNull(), start + F.col("_n") - 1),
            "base_hash": F.when(F.col("_n") == 1, F.col("_h")).otherwise(F.lag("payload_hash").over(w)),
            "predicted_version": start + F.col("_n"),
            "depends_on": F.lag("operation_id").over(w),
        }
    ).drop("_v", "_h", "_n")


def retry(batch: DataFrame, now: int) -> DataFrame:
    """The batch with attempts raised and the due time of the most tried operation's backoff."""
    tries = batch.agg(F.coalesce(F.max("attempts"), F.lit(1)).alias("_t"))
    return (
        batch.crossJoin(F.broadcast(tries))  # one row
        .withColumns(
            {"state": F.lit("retrying"), "due_at": F.lit(now) + backoff_micros(F.greatest("_t", F.lit(1))), "attempts": F.col("attempts") + 1}
        )
        .drop("_t")
    )


def listing(queue: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest unsettled operations, 1 to 500 of them."""
    return queue.where("state <> 'settled'").orderBy("created_at", "operation_id").limit(min(max(limit, 1), 500))


def prepare_batch(queue: DataFrame, baselines: DataFrame, owner: str, now: int, new_batch: str, *key: str, limit: int = BATCH) -> DataFrame:
    """The batch to send: the retrying batch whose operation is due and oldest, exactly as it was, else a new one.

    Rows are in flight, one attempt on, and come in batch_ordinal order; a new
    batch has at most 100 operations, chained on their entities' baselines.
    """
    tried = queue.where((F.col("state") == "retrying") & F.col("batch_id").isNotNull())
    due = tried.where(F.col("due_at").isNull() | (F.col("due_at") <= now)).agg(
        F.min_by("batch_id", F.struct("created_at", "operation_id")).alias("_due")
    )
    names = ("base_version", "base_hash", "depends_on")
    # One row says which batch is due, if any.
    replay = tried.crossJoin(F.broadcast(due)).where("batch_id = _due").drop("_due", *names)
    kept = tried.select("operation_id", *[F.col(n) if n in tried.columns else F.lit(None).alias(n) for n in names])
    replay = replay.join(kept, "operation_id").select(*[c for c in queue.columns if c not in names], *names)
    fresh = eligible(queue, owner, now, min(max(limit, 1), BATCH)).withColumn("batch_id", F.lit(new_batch))
    fresh = chain(ordinals(fresh, "batch_id"), baselines, *key).drop("predicted_version")
    fresh = fresh.crossJoin(F.broadcast(due)).where("_due is null").select(*replay.columns)
    return (
        replay.unionByName(fresh)
        .withColumns({"state": F.lit("in_flight"), "attempts": F.col("attempts") + 1, "due_at": F.lit(None).cast("long")})
        .orderBy("batch_ordinal", "operation_id")
    )


def responses(journal: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (operation_id, request_hash) with outcome: new, replay with the stored response, or mismatch."""
    j = journal.select("operation_id", F.col("request_hash").alias("_q"), F.col("response").alias("_r"))
    outcome = F.when(F.col("_q").isNull(), "new").when(F.col("_q") == F.col("request_hash"), "replay").otherwise("mismatch")
    joined = requests.join(j, "operation_id", "left").withColumn("outcome", outcome)
    return joined.withColumn("response", F.when(F.col("outcome") == "replay", F.col("_r"))).drop("_q", "_r")


def cursors(steps: DataFrame, *key: str) -> DataFrame:
    """(key, pulled_cursor, acknowledged_cursor) after steps (key, seq, kind, cursor).

    ``stage`` brings the cursor of an applied page; ``commit`` acknowledges the
    last one staged since the commit before, and leaves none staged.
    """
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    commit = F.col("kind") == "commit"
    rows = steps.withColumn("_block", F.coalesce(F.sum(commit.cast("int")).over(before), F.lit(0)))
    by = rows.groupBy(*key, "_block").agg(
        F.max_by("cursor", F.when(F.col("kind") == "stage", F.col("seq"))).alias("_staged"), F.max(commit).alias("_done")
    )
    return by.groupBy(*key).agg(
        F.max_by(F.when(~F.col("_done"), F.col("_staged")), "_block").alias("pulled_cursor"),
        F.max_by("_staged", F.when(F.col("_done") & F.col("_staged").isNotNull(), F.col("_block"))).alias("acknowledged_cursor"),
    )


# What a restart does to each kind of state: (states, state after).
RECOVERY = {
    "operations": (("in_flight",), "retrying"),
    "runtime": (("pulling", "applying", "resolving", "pushing", "settling"), "idle"),
    "rebuilds": (("applying", "swapping"), "ready"),
    "resolutions": (("in_flight",), "pending"),
}


def recovered(kind: str, rows: DataFrame) -> DataFrame:
    """Rows of one kind of state after a restart; done again, it changes nothing."""
    states, to = RECOVERY[kind]
    return rows.withColumn("state", F.when(F.col("state").isin(*states), to).otherwise(F.col("state")))


def recovery_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows of each kind a restart changes."""
    counts = [t.agg(F.count_if(F.col("state").isin(*RECOVERY[k][0])).alias(k)) for k, t in tables.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), counts)  # one row each


def change_from_wire(body: Column) -> Column:
    """A change from its JSON, with its time in microseconds."""
    fields = "sequence string, entityType string, entityId string, kind string, version long, contentHash string, snapshot string, updatedAt string"
    x = F.from_json(body, fields)
    return F.struct(
        x["sequence"].alias("sequence"), x["entityType"].alias("entity_type"), x["entityId"].alias("entity_id"), x["kind"].alias("kind"),
        x["version"].alias("version"), x["contentHash"].alias("content_hash"), x["snapshot"].alias("snapshot"),
        F.unix_micros(F.try_to_timestamp(x["updatedAt"])).alias("updated_at"),
    )


def operation_to_wire() -> Column:
    """An operation as JSON: a missing base is left out, a missing payload is an explicit null.

    Columns: entity_id, entity_type, kind, operation_id (strings), base_version,
    base_hash, depends_on (an array of strings) and payload (a JSON object).
    """
    quoted = lambda c: F.to_json(F.array(F.col(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2)
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    parts = F.array(
        F.when(F.col("base_hash").isNotNull(), part("baseContentHash", quoted("base_hash"))),
        F.when(F.col("base_version").isNotNull(), part("baseVersion", F.col("base_version").cast("string"))),
        part("dependsOn", F.to_json(F.coalesce("depends_on", F.array().cast("array<string>")))),
        part("entityId", quoted("entity_id")),
        part("entityType", quoted("entity_type")),
        part("kind", quoted("kind")),
        part("operationId", quoted("operation_id")),
        part("payload", F.coalesce("payload", F.lit("null"))),
    )
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda x: x.isNotNull()), ","), F.lit("}"))


def state_counts(queue: DataFrame) -> DataFrame:
    """One row: operations pending, retrying, in conflict and failed."""
    states = ("pending", "retrying", "conflict", "failed")
    return queue.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def latest_states(queue: DataFrame, *key: str) -> DataFrame:
    """Each entity's state by its latest unsettled operation; in_flight reads syncing."""
    last = F.max_by("state", F.struct("created_at", "operation_id"))
    rows = queue.where("state <> 'settled'").groupBy(*key).agg(last.alias("status"))
    return rows.withColumn("status", F.when(F.col("status") == "in_flight", "syncing").otherwise(F.col("status")))


def last_error(queue: DataFrame) -> DataFrame:
    """One row: the error code of the most recently updated operation that has one."""
    return queue.where("error_code is not null").agg(
        F.max_by("error_code", F.struct("updated_at", "operation_id")).alias("error_code")
    )


def status(auth_ready: Column, running: Column, transient: Column, conflict: Column, failed: Column, retrying: Column, pending: Column) -> Column:
    """The first state that holds, in order of precedence."""
    return (
        F.when(~auth_ready, "authRequired")
        .when(conflict > 0, "conflict")
        .when(failed > 0, "failed")
        .when(running, "syncing")
        .when(transient.isNotNull(), transient)
        .when(retrying > 0, "retrying")
        .when(pending > 0, "pending")
        .otherwise("synced")
    )


def unmatched(sent: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(operation_id, problem): sent without one outcome, or outcomes of nothing sent; empty for a bijection."""
    a = sent.groupBy("operation_id").agg(F.count("*").alias("sent"))
    b = outcomes.groupBy("operation_id").agg(F.count("*").alias("got"))
    joined = a.join(b, "operation_id", "full_outer")
    problem = (
        F.when(F.col("got").isNull(), "missing")
        .when(F.col("sent").isNull(), "unexpected")
        .when((F.col("got") > 1) | (F.col("sent") > 1), "repeated")
    )
    return joined.select("operation_id", problem.alias("problem")).where("problem is not null")


def replay_mismatches(journal: DataFrame, replayed: DataFrame) -> DataFrame:
    """Operations that come again with another request or response."""
    r = replayed.select("operation_id", F.col("request_hash").alias("_q"), F.col("response").alias("_r"))
    return journal.join(r, "operation_id").where((F.col("request_hash") != F.col("_q")) | (F.col("response") != F.col("_r"))).select("operation_id")


def recover(queue: DataFrame) -> DataFrame:
    """After a restart, what was in flight is retried; applying it again changes nothing."""
    return queue.withColumn("state", F.when(F.col("state") == "in_flight", "retrying").otherwise(F.col("state")))


def settle(batch: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The batch with the state that each operation's outcome brings."""
    o = outcomes.select("operation_id", F.col("status").alias("_s"))
    new = F.when(F.col("_s").isin("accepted", "duplicate"), "settled").when(F.col("_s") == "conflict", "conflict").when(F.col("_s").isNull(), F.col("state")).otherwise("failed")
    return batch.join(o, "operation_id", "left").withColumn("state", new).drop("_s")

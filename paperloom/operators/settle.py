"""Queue, journal, conflicts and baseline as tables that change in one commit: receiving, preparing, retrying, settling, rebuilding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, payload_hash
from ..sources.segments import SEGMENT, Segments
from ..sources.shared import checkpoint
from ..streaming import exchange
from . import outbox

#: Segments of a table from which the smaller ones are folded.
MAX_SEGMENTS = 16

QUEUE = (
    "operation_id string, entity_type string, entity_id string, kind string, base_version long, base_hash string, payload string, "
    "depends_on array<string>, batch_id string, state string, error_code string, updated_at long, "
    "created_at long, owner_id string, attempts long, due_at long, batch_ordinal int"
)
REMOTE = "sequence string, entity_type string, entity_id string, kind string, version long, content_hash string, snapshot string, updated_at long"
OUTCOME = "operation_id string, status string, entity_version long, content_hash string, conflict_id string, response string"
JOURNAL = "operation_id string, request_hash string, response string, recorded_at long"
CONFLICT = (
    "conflict_id string, entity_type string, entity_id string, operation_id string, base_version long, base_hash string, "
    "local_snapshot string, cloud_version long, cloud_hash string, hydration_state string, resolution_state string, created_at long, "
    "reason string, base_snapshot string, cloud_snapshot string"
)
BASELINE = "entity_type string, entity_id string, version long, content_hash string, tombstone boolean, snapshot string, sequence string, updated_at long"
# What each status of an outcome makes of its operation, and the code that then explains it (fixed values).
STATES = {"applied": "settled", "noop": "settled", "conflict": "conflict", "rejected": "failed", "dependencyFailed": "failed"}
CODES = {"conflict": "SYNC_CONFLICT", "failed": "SYNC_OPERATION_FAILED"}


class CorruptResponse(ValueError):
    """A response that does not fit its batch; nothing was changed."""


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order and types; those that are not there are null."""
    fields = [f.split() for f in schema.split(", ")]
    return df.select([(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _json(name: str) -> F.Column:
    """A JSON column in canonical form; the text null for none."""
    return F.coalesce(canonical_json(F.col(name)), F.lit("null"))


def _lookup(table: dict[str, str], key):
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def request_digest() -> F.Column:
    """SHA-256 of an operation as canonical JSON, of ``QUEUE``'s columns."""
    body = F.struct(
        F.col("base_hash").alias("baseContentHash"), F.col("base_version").alias("baseVersion"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("dependsOn"),
        F.col("entity_id").alias("entityId"), F.col("entity_type").alias("entityType"), "kind", F.col("operation_id").alias("operationId"), F.try_parse_json("payload").alias("payload"),
    )
    return F.sha2(canonical_json(F.to_json(body, {"ignoreNullFields": "false"})), 256)


def judge(queue: DataFrame, journal: DataFrame, outcomes: DataFrame, batch_id: str) -> DataFrame:
    """One row for each operation of the batch or of the outcomes: the operation, its outcome, its new state, and the problem if there is one.

    A batch in flight wants exactly one outcome for each of its operations.
    One that has been settled as its outcomes say (state ``again``) is a
    replay.  problem: missing, unexpected, repeated, status (unknown),
    conflict (without id, version or a 64-digit hash), or response (the
    journal has another request or response).
    """
    got = outcomes.groupBy("operation_id").agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in _names(OUTCOME) if c != "operation_id"])).alias("o"))
    own = queue.where(F.col("batch_id") == batch_id).withColumn("_digest", request_digest())
    known = journal.select("operation_id", F.col("request_hash").alias("_q"), F.col("response").alias("_r"))
    x = own.join(got, "operation_id", "full_outer").join(known, "operation_id", "left")
    response = canonical_json(F.col("o.response"))
    new = _lookup(STATES, F.col("o.status"))
    again = (F.col("state") == new) & F.col("_q").eqNullSafe(F.col("_digest")) & F.col("_r").eqNullSafe(response)
    bad_conflict = F.col("o.conflict_id").isNull() | F.col("o.entity_version").isNull() | ~F.coalesce(F.col("o.content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    problem = (
        F.when(F.col("_n").isNull() & (F.col("state") == "in_flight"), "missing")
        .when(F.col("_n") > 1, "repeated")
        .when(F.col("_n").isNotNull() & (F.col("state").isNull() | ((F.col("state") != "in_flight") & ~F.coalesce(again, F.lit(False)))), "unexpected")
        .when(F.col("_n").isNotNull() & new.isNull(), "status")
        .when((new == "conflict") & bad_conflict, "conflict")
        .when(F.col("_q").isNotNull() & ((F.col("_q") != F.col("_digest")) | ~F.col("_r").eqNullSafe(response)), "response")
    )
    return x.where("_n is not null or state = 'in_flight'").select(
        "operation_id", *[c for c in _names(QUEUE) if c not in ("operation_id", "state", "error_code", "updated_at")], F.col("_digest").alias("request_hash"),
        response.alias("response"), "o.status", "o.entity_version", "o.content_hash", "o.conflict_id",
        F.when(F.coalesce(again, F.lit(False)), "again").otherwise(new).alias("state"), problem.alias("problem"),
    )


class CorruptChange(ValueError):
    """A remote version that was seen with another hash; nothing was changed."""


class Exchanged:
    """The four tables of an exchange with a service, in one store.  A later row of an operation or entity replaces the one before."""

    KEYS = {"queue": (QUEUE, ("operation_id",)), "journal": (JOURNAL, ("operation_id",)), "conflicts": (CONFLICT, ("conflict_id",)), "baseline": (BASELINE, ("entity_type", "entity_id"))}

    def __init__(self, spark: SparkSession, path: str):
        self.store = Segments(spark, path)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version: of each key the row of the last segment, or, of conflicts and journal, the first."""
        return self._latest(name, self.store.read(name, self.KEYS[name][0], self.store.manifest(version)))

    def _latest(self, name: str, rows: DataFrame) -> DataFrame:
        schema, key = self.KEYS[name]
        rest = [c for c in _names(schema) if c not in key]
        pick = F.min_by if name in ("conflicts", "journal") else F.max_by
        return rows.groupBy(*key).agg(pick(F.struct(*rest), SEGMENT).alias("_r")).select(*key, "_r.*").select(*_names(schema))

    def _commit(self, base: dict, tables: dict[str, DataFrame], facts: dict | None = None, replace: dict[str, DataFrame] | None = None) -> dict:
        """One version with new rows of tables; where a table has many segments, another that folds them follows."""
        new = self.store.commit(base, {n: _shaped(df, self.KEYS[n][0]) for n, df in tables.items()}, {n: _shaped(df, self.KEYS[n][0]) for n, df in (replace or {}).items()}, facts=facts)
        folds = {n: first for n in self.KEYS if (first := self.store.foldable(new, n, MAX_SEGMENTS)) is not None}
        if folds:
            whole = {n: (first, self._latest(n, self.store.read(n, self.KEYS[n][0], new, first))) for n, first in folds.items()}
            new = self.store.commit(new, fold=whole)
        return new

    def enqueue(self, operations: DataFrame) -> dict:
        """Add or replace operations (columns of ``QUEUE``; missing ones are null)."""
        return self._commit(self.store.manifest(), {"queue": operations})

    # --- what comes in ---------------------------------------------------------------------------

    def _received(self, page: DataFrame, baseline: DataFrame, queue: DataFrame, now: int) -> dict[str, DataFrame]:
        """The rows that a page of changes (``REMOTE`` with at, its order) brings to baseline, queue and conflicts."""
        page = checkpoint(page)
        keys = page.select(*exchange.KEY).distinct()
        mine = checkpoint(queue.where("state <> 'settled'").join(keys, list(exchange.KEY), "left_semi").withColumn("payload_hash", payload_hash(F.col("payload"))))
        old = checkpoint(baseline.join(keys, list(exchange.KEY), "left_semi"))
        events = _shaped(page.withColumn("side", F.lit("remote")), exchange.INPUT)
        judged = checkpoint(exchange.received(events, exchange.snapshot(old, mine)))
        wrong = judged.where("outcome = 'corrupt'").select("entity_type", "entity_id").limit(1).collect()
        if wrong:
            raise CorruptChange(f"one version of {wrong[0][0]} {wrong[0][1]} has two hashes")
        applied = judged.where("outcome = 'applied'").join(page, [*exchange.KEY, "at"])
        stamp = F.lit(now).cast("long")
        last = applied.groupBy(*exchange.KEY).agg(F.max_by(F.struct("version", "content_hash", F.col("snapshot").isNull().alias("tombstone"), _json("snapshot").alias("snapshot"), "sequence", "updated_at"), "at").alias("_r"))
        decided = judged.where("decision is not null").groupBy("operation_id").agg(F.max_by("decision", "at").alias("_d"))
        state = F.when(F.col("_d") == "settle", "settled").otherwise("conflict")
        met = applied.where("decision = 'conflict'").select(
            *exchange.KEY, "at", "operation_id", "reason", "base_known", F.col("version").alias("cloud_version"), F.col("content_hash").alias("cloud_hash"), _json("snapshot").alias("cloud_snapshot")
        )
        own = mine.select("operation_id", "base_version", "base_hash", _json("payload").alias("local_snapshot"))
        # A base is known where it is the version before the change: the stored one, or an earlier change of the page.
        known = old.select(*exchange.KEY, F.col("version").alias("base_version"), F.col("content_hash").alias("base_hash"), F.col("snapshot").alias("base_snapshot"))
        known = known.union(applied.select(*exchange.KEY, "version", "content_hash", _json("snapshot"))).dropDuplicates([*exchange.KEY, "base_version", "base_hash"])
        conflicts = met.join(own, "operation_id").join(known, [*exchange.KEY, "base_version", "base_hash"], "left").select(
            F.sha2(F.concat_ws("/", "operation_id", F.col("cloud_version").cast("string"), "cloud_hash"), 256).alias("conflict_id"), *exchange.KEY, "operation_id", "base_version", "base_hash",
            "local_snapshot", "cloud_version", "cloud_hash", F.lit("complete").alias("hydration_state"), F.lit("unresolved").alias("resolution_state"), stamp.alias("created_at"), "reason",
            F.when(F.col("base_known"), F.col("base_snapshot")).alias("base_snapshot"), "cloud_snapshot",
        )
        changed = mine.join(decided, "operation_id").withColumns({"state": state, "updated_at": stamp}).withColumn("error_code", _lookup(CODES, F.col("state")))
        return {"baseline": last.select(*exchange.KEY, "_r.*"), "queue": changed, "conflicts": conflicts}

    def _open(self, owner: str | None) -> DataFrame:
        """The queue as one account sees it: its own operations and those of no one yet."""
        return self.table("queue").where(F.col("owner_id").isNull() | F.col("owner_id").eqNullSafe(F.lit(owner)))

    def receive(self, changes: DataFrame, cursor: str, now: int, owner: str | None = None) -> dict:
        """Take in one page of remote changes (``REMOTE`` with at, its order) and stage its cursor, all in one commit.

        What a change does is told by ``streaming.exchange``; a corrupt one
        raises and changes nothing.  A page that comes again changes nothing
        but what the first time was.
        """
        if not cursor:
            raise ValueError("a page needs a next cursor")
        base = self.store.manifest()
        rows = self._received(changes, self.table("baseline"), self._open(owner), now)
        return self._commit(base, rows, {"pulled_cursor": cursor})

    def acknowledge(self) -> dict:
        """The staged cursor is now acknowledged."""
        base = self.store.manifest()
        pulled = base["facts"].get("pulled_cursor")
        return base if pulled is None else self.store.commit(base, facts={"pulled_cursor": None, "acknowledged_cursor": pulled})

    def rebuild(self, entries: DataFrame, cursor: str, now: int, owner: str | None = None) -> dict:
        """Put a complete snapshot (``REMOTE`` with at over all its pages) in place of the baseline, and judge each entry against the queue.

        The last row of an entity in the pages counts.  Operations stay, but
        for those that an entry settles or conflicts with.
        """
        base = self.store.manifest()
        rest = [c for c in entries.columns if c not in exchange.KEY]
        last = entries.groupBy(*exchange.KEY).agg(F.max_by(F.struct(*rest), "at").alias("_r")).select(*exchange.KEY, "_r.*")
        none = self.store.spark.createDataFrame([], BASELINE)
        rows = self._received(last, none, self._open(owner), now)
        return self._commit(base, {n: rows[n] for n in ("queue", "conflicts")}, {"pulled_cursor": cursor}, {"baseline": rows["baseline"]})

    # --- what goes out ---------------------------------------------------------------------------

    def prepare(self, owner: str, now: int, new_batch: str, limit: int = outbox.BATCH) -> DataFrame:
        """The batch to send, in order and in flight from now on: the due one that was tried before, as it was, or a new one."""
        base = self.store.manifest()
        queue = self.table("queue").withColumn("payload_hash", payload_hash(F.col("payload")))
        single = queue.withColumns({"_deps": F.col("depends_on"), "depends_on": F.lit(None).cast("string"), "attempts": F.coalesce("attempts", F.lit(0))})
        chosen = checkpoint(outbox.prepare_batch(single, self.table("baseline"), owner, now, new_batch, *exchange.KEY, limit=limit))
        chained = F.when(F.col("depends_on").isNotNull(), F.array("depends_on")).otherwise(F.array().cast("array<string>"))
        # A batch that is sent again keeps its dependencies, as it keeps its bases.
        again = F.col("batch_id") != new_batch
        kept = chosen.withColumns({"depends_on": F.when(again & F.col("_deps").isNotNull(), F.col("_deps")).otherwise(chained), "error_code": F.lit(None).cast("string"), "updated_at": F.lit(now).cast("long")})
        kept = checkpoint(_shaped(kept.drop("_deps"), QUEUE))
        if not kept.isEmpty():
            self._commit(base, {"queue": kept})
        return kept.orderBy("batch_ordinal", "operation_id")

    def retry(self, batch_id: str, code: str, now: int) -> dict:
        """A batch that could not be sent waits for its backoff."""
        base = self.store.manifest()
        sent = self.table("queue").where((F.col("batch_id") == batch_id) & (F.col("state") == "in_flight"))
        waits = outbox.retry(sent.withColumn("attempts", F.coalesce("attempts", F.lit(0))), now)
        return self._commit(base, {"queue": waits.withColumns({"attempts": F.col("attempts") - 1, "error_code": F.lit(code), "updated_at": F.lit(now).cast("long")})})

    def settle(self, batch_id: str, outcomes: DataFrame, now: int) -> dict:
        """Take in the outcomes of a batch, all tables together or none; the manifest afterwards.

        A response that does not fit raises and changes nothing; a batch that
        was settled in the same way before changes nothing either.
        """
        base = self.store.manifest()
        judged = checkpoint(judge(self.table("queue"), self.table("journal"), outcomes, batch_id))
        problems = judged.where("problem is not null").groupBy("problem").count().orderBy("problem").collect()  # a row for each kind
        if problems:
            raise CorruptResponse("; ".join(f"{r['problem']}: {r['count']}" for r in problems))
        fresh = judged.where("state <> 'again'")
        if fresh.isEmpty():
            return base
        stamp = F.lit(now).cast("long")
        response = F.parse_json("response")
        tables = {
            "journal": fresh.select("operation_id", "request_hash", "response", stamp.alias("recorded_at")),
            "queue": fresh.withColumns({"error_code": _lookup(CODES, F.col("state")), "updated_at": stamp}).select(*_names(QUEUE)),
            "conflicts": fresh.where("state = 'conflict'").select(
                "conflict_id", "entity_type", "entity_id", "operation_id", "base_version", "base_hash", _json("payload").alias("local_snapshot"),
                F.col("entity_version").alias("cloud_version"), F.col("content_hash").alias("cloud_hash"), F.lit("placeholder").alias("hydration_state"),
                F.lit("unresolved").alias("resolution_state"), stamp.alias("created_at"),
            ).dropDuplicates(["conflict_id"]),
            "baseline": fresh.where("state = 'settled' and entity_version is not null and content_hash is not null")
            .groupBy("entity_type", "entity_id")  # of several operations of an entity, the one of the highest version
            .agg(F.max_by(F.struct(F.col("entity_version").alias("version"), "content_hash", F.col("payload").isNull().alias("tombstone"),
                                   _json("payload").alias("snapshot"),
                                   F.coalesce(F.try_variant_get(response, "$.changeCursor", "string"), F.lit("push")).alias("sequence"), stamp.alias("updated_at")),
                          F.struct("entity_version", "operation_id")).alias("_r"))
            .select("entity_type", "entity_id", "_r.*"),
        }
        return self._commit(base, tables)

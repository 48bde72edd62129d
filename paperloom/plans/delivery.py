"""Registered queries of conflicts, batches, papers, attachments and wire forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import conflicts, inventory, outbox, papers, versions
from . import tables as T
from .queries import HISTORY, LOG, query

NOW = 1704585600000000

# --- conflicts ---------------------------------------------------------------------------------

EVENTS = """
SELECT user_id AS conflict_id, event_id AS seq, CASE WHEN event_type IN ('purchase', 'error') THEN 'settle' ELSE 'stage' END AS kind,
  user_id * 10 + event_id % 3 AS operation_id, CASE event_id % 4 WHEN 0 THEN 'undo' WHEN 1 THEN 'saveCopy' ELSE 'keepLocal' END AS action,
  1 + event_id % 2 AS version, 'h' || (1 + event_id % 2) AS content_hash, 'q' || event_id % 5 AS request_hash, 'r' || event_id % 2 AS response_hash FROM events"""


def _decisions(spark, d):
    e, n = T.read(spark, d, "events"), F.col("event_id")
    tag = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return e.select(
        F.col("user_id").alias("conflict_id"), n.alias("seq"), F.when(F.col("event_type").isin("purchase", "error"), "settle").otherwise("stage").alias("kind"),
        (F.col("user_id") * 10 + n % 3).alias("operation_id"), F.when(n % 4 == 0, "undo").when(n % 4 == 1, "saveCopy").otherwise("keepLocal").alias("action"),
        (1 + n % 2).alias("version"), tag("h", 1 + n % 2).alias("content_hash"), tag("q", n % 5).alias("request_hash"), tag("r", n % 2).alias("response_hash"),
        (1 + n % 2).alias("accepted_version"), tag("h", 1 + n % 2).alias("accepted_hash"),
    )


@query(f"""
WITH ev AS ({EVENTS}),
c AS (SELECT DISTINCT user_id AS conflict_id, user_id % 7 <> 0 AS ready FROM events WHERE user_id % 9 <> 0),
s1 AS (SELECT DISTINCT ON (conflict_id) ev.* FROM ev JOIN c USING (conflict_id) WHERE ready AND kind = 'stage' AND action <> 'undo' AND version = 1 ORDER BY conflict_id, seq),
t1 AS (SELECT DISTINCT ON (e.conflict_id) e.* FROM ev e JOIN s1 s USING (conflict_id)
       WHERE e.kind = 'settle' AND e.seq > s.seq AND e.operation_id = s.operation_id AND e.action = s.action ORDER BY e.conflict_id, e.seq),
c1 AS (SELECT c.conflict_id, CASE WHEN s1.action <> 'saveCopy' AND t1.seq IS NOT NULL THEN t1.version ELSE 1 END AS v1 FROM c LEFT JOIN s1 USING (conflict_id) LEFT JOIN t1 USING (conflict_id)),
s2 AS (SELECT DISTINCT ON (e.conflict_id) e.* FROM ev e JOIN t1 t USING (conflict_id) JOIN c1 USING (conflict_id)
       WHERE e.kind = 'stage' AND e.action = 'undo' AND e.operation_id <> t.operation_id AND e.seq > t.seq AND e.version = v1 ORDER BY e.conflict_id, e.seq),
t2 AS (SELECT DISTINCT ON (e.conflict_id) e.* FROM ev e JOIN s2 s USING (conflict_id)
       WHERE e.kind = 'settle' AND e.seq > s.seq AND e.operation_id = s.operation_id AND e.action = s.action ORDER BY e.conflict_id, e.seq)
SELECT e.conflict_id, e.seq, CASE WHEN e.kind = 'stage' THEN
    CASE WHEN c.conflict_id IS NULL THEN 'notFound' WHEN e.seq = s1.seq OR e.seq = s2.seq THEN 'staged'
         WHEN e.seq > s1.seq AND e.operation_id = s1.operation_id THEN CASE WHEN e.request_hash = s1.request_hash THEN 'existing' ELSE 'rejected' END
         WHEN e.seq > s2.seq AND e.operation_id = s2.operation_id THEN CASE WHEN e.request_hash = s2.request_hash THEN 'existing' ELSE 'rejected' END
         WHEN NOT ready THEN 'notReady'
         WHEN e.version <> CASE WHEN e.seq > t2.seq THEN t2.version WHEN e.seq > t1.seq THEN v1 ELSE 1 END THEN 'stale' ELSE 'unavailable' END
  ELSE CASE WHEN e.seq > s1.seq AND e.operation_id = s1.operation_id THEN
              CASE WHEN e.seq = t1.seq THEN 'accepted' WHEN e.seq > t1.seq THEN CASE WHEN e.response_hash = t1.response_hash THEN 'replayed' ELSE 'corrupt' END ELSE 'rejected' END
            WHEN e.seq > s2.seq AND e.operation_id = s2.operation_id THEN
              CASE WHEN e.seq = t2.seq THEN 'accepted' WHEN e.seq > t2.seq THEN CASE WHEN e.response_hash = t2.response_hash THEN 'replayed' ELSE 'corrupt' END ELSE 'rejected' END
            ELSE 'notFound' END END AS outcome,
  CASE WHEN t2.seq IS NOT NULL THEN 'undone' WHEN s2.seq IS NOT NULL THEN 'resolving' WHEN t1.seq IS NOT NULL THEN 'resolved' WHEN s1.seq IS NOT NULL THEN 'resolving' ELSE 'unresolved' END AS state,
  coalesce(t2.version, v1) AS cloud_version
FROM ev e LEFT JOIN c USING (conflict_id) LEFT JOIN c1 USING (conflict_id) LEFT JOIN s1 USING (conflict_id) LEFT JOIN t1 USING (conflict_id) LEFT JOIN s2 USING (conflict_id) LEFT JOIN t2 USING (conflict_id)
""")
def conflict_resolution(spark, d):
    u = F.col("user_id")
    stored = T.read(spark, d, "events").select("user_id").distinct().where(u % 9 != 0).select(
        u.alias("conflict_id"), F.lit(1).cast("long").alias("cloud_version"), F.lit("h1").alias("cloud_hash"), F.when(u % 7 == 0, "pending").otherwise("complete").alias("hydration")
    )
    return conflicts.resolve(stored, _decisions(spark, d)).select("conflict_id", "seq", "outcome", "state", "cloud_version")


@query(f"""
WITH n AS (SELECT entity_id AS conflict_id, arg_max(version, (changed_at, version)) AS cloud_version, arg_max(content_hash, (changed_at, version)) AS cloud_hash, epoch_us(max(changed_at)) AS at
           FROM ({HISTORY}) WHERE op_id % 3 = 0 GROUP BY 1),
s AS (SELECT DISTINCT user_id AS conflict_id, CASE WHEN user_id % 2 = 0 THEN 'resolving' ELSE 'resolved' END AS state FROM events WHERE user_id % 4 < 2)
SELECT conflict_id, coalesce(n.cloud_version, 1) AS cloud_version, coalesce(n.cloud_hash, 'old') AS cloud_hash, CASE WHEN n.at IS NOT NULL THEN 'complete' ELSE 'pending' END AS hydration,
  coalesce(state, 'unresolved') AS resolution_state, CASE WHEN state IS NOT NULL THEN 5 ELSE n.at END AS created_at, coalesce(n.at, 5) AS updated_at
FROM n FULL JOIN s USING (conflict_id)
""")
def conflict_store(spark, d):
    u, none = F.col("user_id"), F.lit(None).cast("string")
    old = T.read(spark, d, "events").select("user_id").distinct().where(u % 4 < 2).select(
        u.alias("conflict_id"), F.lit("a").alias("account_id"), F.lit(None).cast("long").alias("base_version"), none.alias("base_hash"), none.alias("base"), none.alias("local"),
        F.lit(1).cast("long").alias("cloud_version"), F.lit("old").alias("cloud_hash"), none.alias("cloud"), F.lit("divergentContent").alias("reason"), F.lit("question").alias("entity_type"),
        u.cast("string").alias("entity_id"), none.alias("operation_id"), F.lit("pending").alias("hydration"), F.when(u % 2 == 0, "resolving").otherwise("resolved").alias("resolution_state"),
        F.lit(5).cast("long").alias("created_at"), F.lit(5).cast("long").alias("updated_at"),
    )
    new = T.history(spark, d).where("op_id % 3 = 0").select(
        F.col("entity_id").alias("conflict_id"), F.lit("a").alias("account_id"), F.lit(1).cast("long").alias("base_version"), F.lit("h").alias("base_hash"), F.lit("{}").alias("base"),
        F.lit("{}").alias("local"), F.col("version").alias("cloud_version"), F.col("content_hash").alias("cloud_hash"), F.lit("{}").alias("cloud"), F.lit("divergentContent").alias("reason"),
        F.lit("question").alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"), F.unix_micros(F.col("changed_at").cast("timestamp")).alias("received_at"),
    )
    return conflicts.store(old, new).select("conflict_id", "cloud_version", "cloud_hash", "hydration", "resolution_state", "created_at", "updated_at")


RESOLUTIONS = "SELECT op_id AS operation_id, entity_id AS conflict_id, CASE WHEN state = 'settled' THEN 'accepted' WHEN state = 'pending' THEN 'pending' ELSE 'in_flight' END AS state, op_id % 100 AS created_at, kind AS action FROM"


def _resolutions(spark, d):
    s = F.when(F.col("state") == "settled", "accepted").when(F.col("state") == "pending", "pending").otherwise("in_flight")
    return T.log(spark, d).select(F.col("op_id").alias("operation_id"), F.col("entity_id").alias("conflict_id"), s.alias("state"), (F.col("op_id") % 100).alias("created_at"), F.col("kind").alias("action"))


@query(f"""
WITH c AS (SELECT entity_id AS conflict_id, CASE entity_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved' ELSE 'resolving' END AS resolution_state, epoch_us(max(changed_at)) AS updated_at FROM ({LOG}) GROUP BY 1),
r AS (SELECT conflict_id, string_agg(operation_id || ':' || action, ',' ORDER BY created_at, operation_id) AS accepted FROM ({RESOLUTIONS} ({LOG})) WHERE state = 'accepted' GROUP BY 1)
SELECT row_number() OVER (ORDER BY CASE resolution_state WHEN 'unresolved' THEN 0 WHEN 'resolving' THEN 1 ELSE 2 END, updated_at DESC, conflict_id) AS place, conflict_id, coalesce(accepted, '') AS accepted
FROM c LEFT JOIN r USING (conflict_id) QUALIFY place <= 40
""")
def conflict_listing(spark, d):
    """The first page of a person's conflicts, each with the resolutions accepted for it."""
    e = F.col("entity_id")
    state = F.when(e % 3 == 0, "resolved").when(e % 3 == 1, "unresolved").otherwise("resolving")
    c = T.log(spark, d).groupBy("entity_id").agg(F.unix_micros(F.max("changed_at").cast("timestamp")).alias("updated_at"))
    c = c.select(e.alias("conflict_id"), state.alias("resolution_state"), "updated_at")
    rows = conflicts.listed(c, _resolutions(spark, d)).limit(40).withColumn("place", F.monotonically_increasing_id() + 1)
    text = F.transform("resolutions", lambda r: F.concat(r["operation_id"].cast("string"), F.lit(":"), r["action"]))
    return rows.select("place", "conflict_id", F.array_join(text, ",").alias("accepted"))


@query(f"SELECT operation_id, conflict_id FROM ({RESOLUTIONS} ({LOG})) WHERE state = 'pending' ORDER BY created_at, operation_id LIMIT 1")
def next_resolution(spark, d):
    return conflicts.next_resolution(_resolutions(spark, d)).select("operation_id", "conflict_id")


# --- batches -----------------------------------------------------------------------------------


def _tried(spark, d):
    """The queue with retrying operations in batches of an owner's fifty."""
    q = T.queue(spark, d)
    batch = F.when(F.col("state") == "retrying", F.concat(F.lit("b"), F.floor(F.col("operation_id") / 50).cast("string")))
    return q.withColumns({"batch_id": batch, "batch_ordinal": F.when(batch.isNotNull(), (F.col("operation_id") * 7 % 50).cast("int"))})


@query(f"""
WITH q AS (SELECT *, 'b' || op_id // 50 AS batch_id, op_id * 7 % 50 AS batch_ordinal FROM ({LOG}) WHERE state = 'retrying'),
due AS (SELECT arg_min(batch_id, (changed_at, op_id)) AS b FROM q WHERE op_id % 4 <> 0 OR epoch_us(changed_at) <= {NOW})
SELECT op_id AS operation_id, batch_id, CAST(batch_ordinal AS INTEGER) AS batch_ordinal, op_id % 11 + 2 AS attempts, 'in_flight' AS state FROM q, due WHERE batch_id = b
""")
def prepared_batch_replay(spark, d):
    base = versions.current(T.history(spark, d), deleted="include")
    batch = outbox.prepare_batch(_tried(spark, d), base, "owner", NOW, "new", "entity_id")
    return batch.select("operation_id", "batch_id", "batch_ordinal", "attempts", "state")


@query(f"""
WITH b AS (SELECT entity_id, version, content_hash FROM ({HISTORY}) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) = 1),
q AS (SELECT *, row_number() OVER (ORDER BY changed_at, op_id) - 1 AS o FROM ({LOG}) WHERE state = 'pending' AND (op_id % 4 <> 0 OR epoch_us(changed_at) <= {NOW}) QUALIFY o < 60),
n AS (SELECT *, row_number() OVER w AS n, lag(content_hash) OVER w AS ph, lag(op_id) OVER w AS po FROM q WINDOW w AS (PARTITION BY entity_id ORDER BY o))
SELECT op_id AS operation_id, 'new' AS batch_id, CAST(o AS INTEGER) AS batch_ordinal, op_id % 11 + 2 AS attempts, 'in_flight' AS state,
  b.version + n - 1 AS base_version, CASE WHEN n = 1 THEN b.content_hash ELSE ph END AS base_hash, po AS depends_on FROM n JOIN b USING (entity_id)
""")
def prepared_batch_new(spark, d):
    base = versions.current(T.history(spark, d), deleted="include")
    fresh = _tried(spark, d).where("state <> 'retrying'")
    batch = outbox.prepare_batch(fresh, base, "owner", NOW, "new", "entity_id", limit=60)
    return batch.select("operation_id", "batch_id", "batch_ordinal", "attempts", "state", "base_version", "base_hash", "depends_on")


@query(f"SELECT op_id AS operation_id, state FROM ({LOG}) WHERE state <> 'settled' ORDER BY changed_at, op_id LIMIT 500")
def queue_listing(spark, d):
    return outbox.listing(T.queue(spark, d), 9_999).select("operation_id", "state")


@query("""
WITH j AS (SELECT o_orderkey AS op, o_orderstatus AS q, o_orderpriority AS r FROM orders), n AS (SELECT DISTINCT l_orderkey + 10 AS op, l_linestatus AS q FROM lineitem)
SELECT n.op AS operation_id, n.q AS request_hash, CASE WHEN j.op IS NULL THEN 'new' WHEN j.q = n.q THEN 'replay' ELSE 'mismatch' END AS outcome, CASE WHEN j.q = n.q THEN r END AS response FROM n LEFT JOIN j USING (op)
""")
def response_replay(spark, d):
    journal = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("operation_id"), F.col("o_orderstatus").alias("request_hash"), F.col("o_orderpriority").alias("response"))
    asked = T.read(spark, d, "lineitem").select((F.col("l_orderkey") + 10).alias("operation_id"), F.col("l_linestatus").alias("request_hash")).distinct()
    return outbox.responses(journal, asked)


@query("""
WITH s AS (SELECT user_id, event_id AS seq, event_type = 'purchase' AS done FROM events),
c AS (SELECT user_id, seq, (SELECT max(p.seq) FROM s p WHERE p.user_id = s.user_id AND p.done AND p.seq < s.seq) AS since FROM s WHERE done),
a AS (SELECT c.user_id, c.seq, (SELECT max(s.seq) FROM s WHERE s.user_id = c.user_id AND NOT done AND s.seq < c.seq AND s.seq > coalesce(since, -1)) AS got FROM c)
SELECT user_id, (SELECT max(s.seq) FROM s WHERE s.user_id = u.user_id AND NOT done AND s.seq > coalesce((SELECT max(c.seq) FROM c WHERE c.user_id = u.user_id), -1)) AS pulled_cursor,
  (SELECT arg_max(got, a.seq) FROM a WHERE a.user_id = u.user_id AND got IS NOT NULL) AS acknowledged_cursor
FROM (SELECT DISTINCT user_id FROM events) u
""")
def cursor_two_phase(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "commit").otherwise("stage")
    steps = T.read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").alias("cursor"))
    return outbox.cursors(steps, "user_id")


@query("""
SELECT count(*) FILTER (event_type = 'view') AS operations, count(*) FILTER (event_type IN ('click', 'view')) AS runtime,
  count(*) FILTER (event_type = 'error') AS rebuilds, count(*) FILTER (event_type = 'view') AS resolutions FROM events
""")
def recovery_counts(spark, d):
    e = T.read(spark, d, "events")
    names = {"operations": {"view": "in_flight"}, "runtime": {"click": "pulling", "view": "settling"}, "rebuilds": {"error": "swapping"}, "resolutions": {"view": "in_flight"}}

    def states(of):
        out = F.lit("idle")
        for event, state in of.items():
            out = F.when(F.col("event_type") == event, state).otherwise(out)
        return e.select(out.alias("state"))

    return outbox.recovery_counts({k: states(v) for k, v in names.items()})


@query("""
SELECT event_id, CAST(event_id AS VARCHAR) AS sequence, 'question' AS entity_type, 'u' || user_id AS entity_id, 1 + event_id % 40 AS version, epoch_us(ts) AS updated_at,
  CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END AS snapshot FROM events
""")
def change_from_wire(spark, d):
    """Changes as their JSON, read back into columns."""
    e = T.read(spark, d, "events")
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    snapshot = F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.col("props"))
    body = F.format_string(
        '{"sequence":"%d","entityType":"question","entityId":"u%d","kind":"update","version":%d,"contentHash":"h","snapshot":%s,"updatedAt":"%s"}',
        "event_id", "user_id", F.col("event_id") % 40 + 1, snapshot, time,
    )
    rows = e.select("event_id", outbox.change_from_wire(body).alias("c")).select("event_id", "c.*").drop("kind", "content_hash")
    return rows.withColumn("snapshot", F.get_json_object("snapshot", "$.k"))


@query("""
SELECT event_id, '{' || CASE WHEN event_id % 2 = 0 THEN '"baseContentHash":"h' || event_id || '","baseVersion":' || event_id % 9 || ',' ELSE '' END || '"dependsOn":' ||
  CASE WHEN event_id % 5 = 0 THEN '["' || event_id - 1 || '"]' ELSE '[]' END || ',"entityId":"u' || user_id || '","entityType":"question","kind":"' || event_type || '","operationId":"' || event_id ||
  '","payload":' || CASE WHEN event_type = 'error' THEN 'null' ELSE props END || '}' AS body FROM events
""")
def operation_to_wire(spark, d):
    e, n = T.read(spark, d, "events"), F.col("event_id")
    text = lambda c: c.cast("string")
    rows = e.select(
        "event_id", F.concat(F.lit("u"), text(F.col("user_id"))).alias("entity_id"), F.lit("question").alias("entity_type"), F.col("event_type").alias("kind"), text(n).alias("operation_id"),
        F.when(n % 2 == 0, n % 9).alias("base_version"), F.when(n % 2 == 0, F.concat(F.lit("h"), text(n))).alias("base_hash"),
        F.when(n % 5 == 0, F.array(text(n - 1))).alias("depends_on"), F.when(F.col("event_type") != "error", F.col("props")).alias("payload"),
    )
    return rows.select("event_id", outbox.operation_to_wire().alias("body"))


# --- entities and papers -----------------------------------------------------------------------


@query(f"SELECT entity_id, version, kind FROM ({HISTORY}) WHERE entity_id = 7 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) = 1")
def entity_lookup(spark, d):
    return versions.get(T.history(spark, d), 7).select("entity_id", "version", "kind")


CANDIDATES = f"""
WITH h AS (SELECT * FROM ({HISTORY})), c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) = 1),
k AS (SELECT x.entity_id, greatest(x.version - x.entity_id % 3, 1) AS base_version, x.entity_id % 4 AS owner, CASE WHEN x.entity_id % 5 = 0 THEN x.content_hash ELSE 'new' END AS content_hash FROM c x),
b AS (SELECT k.*, h.content_hash AS base_hash FROM k JOIN h ON h.entity_id = k.entity_id AND h.version = base_version)
SELECT b.entity_id, b.base_version, CASE WHEN b.base_version <> c.version THEN 'stale' WHEN c.kind = 'delete' THEN 'deleted' WHEN b.owner = 3 THEN 'rejected' WHEN b.content_hash = c.content_hash THEN 'unchanged' ELSE 'applied' END AS outcome,
  c.version AS current_version FROM b JOIN c ON c.entity_id = b.entity_id"""


def _accepted(spark, d):
    h = T.history(spark, d)
    now = versions.current(h, deleted="include").withColumn("owner", F.when(F.col("entity_id") % 4 == 3, F.lit(9)).otherwise(F.col("entity_id") % 4))
    e = F.col("entity_id")
    asked = now.select("entity_id", F.greatest(F.col("version") - e % 3, F.lit(1)).alias("base_version"), (e % 4).alias("owner"), F.when(e % 5 == 0, F.col("content_hash")).otherwise("new").alias("content_hash"))
    base = h.select("entity_id", F.col("version").alias("base_version"), F.col("content_hash").alias("base_hash"))
    return versions.accept(now, asked.join(base, ["entity_id", "base_version"]), ("owner",))


@query(f"SELECT entity_id, outcome, CASE WHEN outcome = 'applied' THEN current_version + 1 END AS new_version FROM ({CANDIDATES})")
def candidate_acceptance(spark, d):
    return _accepted(spark, d).select("entity_id", "outcome", "new_version")


@query(f"SELECT entity_id, base_version, current_version FROM ({CANDIDATES}) WHERE outcome = 'stale'")
def preserved_candidates(spark, d):
    return versions.preserved(_accepted(spark, d)).select("entity_id", "base_version", "current_version")


PAPERS = """
SELECT o_orderkey AS paper_id, 'Paper ' || o_orderkey AS title, o_orderpriority AS subject, 90 AS duration_minutes, CAST(round(o_totalprice) AS BIGINT) AS total_marks FROM orders"""
PAPER_HASH = """sha256('{"duration_minutes":90,"entity":"paper","items":[' || coalesce(items, '') || '],"schemaVersion":1,"subject":"' || subject || '","title":"' || title || '","total_marks":' || total_marks || '}')"""
PAPER_ITEMS = """
SELECT l_orderkey AS paper_id, string_agg('{"item_order":' || (l_linenumber - 1) || ',"question_id":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) AS items, count(*) AS n FROM lineitem GROUP BY 1"""


def _whole(spark, d):
    own = T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.concat(F.lit("Paper "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("subject"),
        F.lit(90).alias("duration_minutes"), F.round("o_totalprice").cast("long").alias("total_marks"),
    )
    return papers.hydrated(own, T.items(spark, d), "question_id")


@query(f"SELECT paper_id, coalesce(n, 0) AS items, {PAPER_HASH} AS content_hash FROM ({PAPERS}) LEFT JOIN ({PAPER_ITEMS}) USING (paper_id)")
def paper_hydration(spark, d):
    return papers.with_hash(_whole(spark, d)).select("paper_id", F.size("items").cast("long").alias("items"), "content_hash")


@query(f"SELECT paper_id, 1 AS version, {NOW} AS created_at, {NOW} AS updated_at, {PAPER_HASH} AS content_hash FROM ({PAPERS}) LEFT JOIN ({PAPER_ITEMS}) USING (paper_id)")
def paper_creation(spark, d):
    """Papers whose callers give their own version, times and hash, and items out of order."""
    given = {"version": F.lit(99).cast("long"), "created_at": F.lit(1).cast("long"), "content_hash": F.lit("x"), "items": F.reverse("items")}
    return papers.created(_whole(spark, d).withColumns(given), NOW).select("paper_id", "version", "created_at", "updated_at", "content_hash")


@query(f"SELECT paper_id, 'other' AS content_hash, {PAPER_HASH} AS found_hash FROM ({PAPERS}) LEFT JOIN ({PAPER_ITEMS}) USING (paper_id) WHERE paper_id % 50 = 0")
def corrupt_papers(spark, d):
    whole = _whole(spark, d)
    stored = papers.with_hash(whole).select("paper_id", F.when(F.col("paper_id") % 50 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return papers.corrupt(whole, stored)


@query("SELECT l_orderkey AS paper_id, CASE WHEN l_orderkey % 10 = 0 THEN 100 - l_linenumber ELSE l_linenumber - 1 END AS item_order, l_partkey AS question_id FROM lineitem")
def paper_replacement(spark, d):
    """Every tenth paper is updated: its items go and come again in another order."""
    items = T.items(spark, d).select("paper_id", "item_order", "question_id")
    updated = items.where("paper_id % 10 = 0").withColumn("item_order", 99 - F.col("item_order"))
    return papers.replaced(items, updated)


@query("SELECT p_partkey AS id, p_name AS text, p_brand AS subject, len(string_split(p_name, ' ')) AS tags, p_size AS lines FROM part")
def row_decoder(spark, d):
    """Rows whose lists and structs are JSON text, as typed content."""
    p = T.read(spark, d, "part")
    stored = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.to_json(F.array("p_brand")).alias("subjects_json"), F.to_json(F.split("p_name", " ")).alias("tags_json"),
        F.to_json(F.struct(F.col("p_size").alias("lines"))).alias("essay_json"),
    )
    typed = versions.decoded(stored, subjects="array<string>", tags="array<string>", essay="lines int")
    return typed.select("id", "text", F.get("subjects", F.lit(0)).alias("subject"), F.size("tags").cast("long").alias("tags"), "essay.lines")


# --- files -------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey AS owner_id, l_partkey AS attachment_id, p_name AS name FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE p_size % 4 <> 0
""")
def attachment_listing(spark, d):
    links = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner_id"), F.col("l_partkey").alias("attachment_id")).distinct()
    own = T.read(spark, d, "part").select(F.col("p_partkey").alias("attachment_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 == 0, 1).alias("deleted_at"))
    return inventory.attachments_of(links, own).select("owner_id", "attachment_id", "name")


@query("""
SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_size % 3 = 0 THEN 'filename is invalid' END, CASE WHEN p_size % 5 = 0 THEN 'mediaType is invalid' END], lambda x: x IS NOT NULL), ';') AS errors,
  p_size % 7 <> 0 AS safe FROM part
""")
def attachment_rules(spark, d):
    n = F.col("p_size")
    name = F.concat(F.when(n % 3 == 0, "a/").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".png"))
    path = F.concat(F.lit("images/"), F.when(n % 7 == 0, "../").otherwise(""), F.col("p_partkey").cast("string"))
    errors = S.attachment_errors(name, F.when(n % 5 == 0, "image").otherwise("image/png"))
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(errors, ";").alias("errors"), S.safe_archive_path(path).alias("safe"))


@query("""
WITH f AS (SELECT user_id, 'Auto-' || event_id || CASE event_id % 3 WHEN 0 THEN '.bak' WHEN 1 THEN '.bak.age' ELSE '.tmp' END AS name, event_id % 50 AS modified FROM events)
SELECT user_id, name, modified FROM f WHERE name LIKE 'Auto-%' AND (name LIKE '%.bak' OR name LIKE '%.bak.age') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY modified DESC, name DESC) = 1
""")
def newest_backup(spark, d):
    n = F.col("event_id")
    ending = F.when(n % 3 == 0, ".bak").when(n % 3 == 1, ".bak.age").otherwise(".tmp")
    files = T.read(spark, d, "events").select("user_id", F.concat(F.lit("Auto-"), n.cast("string"), ending).alias("name"), (n % 50).alias("modified"))
    return inventory.newest(inventory.automatic_backups(files, "Auto-", ".bak", ".bak.age"), "user_id")


@query("""
SELECT source, count(*) AS files, CAST(sum(n_chars) AS DECIMAL(20, 0)) AS total, CASE WHEN max(n_chars) > 20000 THEN 'file too large' WHEN sum(n_chars) > 100000 THEN 'payload too large' END AS error FROM documents GROUP BY 1
""")
def payload_totals(spark, d):
    files = T.documents(spark, d).select("source", F.col("n_chars").alias("size"))
    return inventory.payload_totals(files, 20_000, 100_000, "source").withColumn("total", F.col("total").cast("decimal(20,0)"))

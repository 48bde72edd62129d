"""Registered queries of stored tables, folds with bases, dependencies, settlement, blobs, images and links, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dependencies, export, inventory, search, settle, versions
from ..operators.search_index import StoredIndex
from ..sources.blobs import BlobStore
from ..sources.shared import passing_folder
from ..streaming import cycle, exchange
from . import tables as T
from .queries import CHANGES, KIND, LOG, ORACLE_SQL, STATE, query

NOW = 1704585600000000

# --- folds with bases --------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE free AS ({ORACLE_SQL["lifecycle_fold"]}),
p AS (SELECT l.entity_id, l.op_id, l.kind, l.content_hash, f.outcome, coalesce(lag(f.version) OVER w, 0) AS v, lag(f.content_hash) OVER w AS h
      FROM ({LOG}) l JOIN free f USING (entity_id, op_id) WINDOW w AS (PARTITION BY l.entity_id ORDER BY l.op_id)),
m AS (SELECT entity_id, op_id, content_hash AS c, CASE WHEN kind = 'update' AND op_id % 13 = 0 THEN 'revert' ELSE kind END AS kind,
        CASE WHEN kind <> 'create' AND op_id % 3 <> 0 THEN v - CASE WHEN op_id % 11 = 0 AND (outcome <> 'applied' OR entity_id % 5 = 0) THEN 1 ELSE 0 END END AS bv,
        CASE WHEN kind <> 'create' AND op_id % 3 <> 0 THEN h END AS bh, 1 + op_id % 5 AS to_version, row_number() OVER (PARTITION BY entity_id ORDER BY op_id) AS n FROM p),
s AS (
  SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS op_id, CAST('' AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS version, CAST(NULL AS VARCHAR) AS h, false AS deleted, CAST([] AS VARCHAR[]) AS past FROM m
  UNION ALL
  SELECT entity_id, n, op_id, outcome, version + (outcome = 'applied')::INT, CASE WHEN outcome = 'applied' THEN nh ELSE h END,
    CASE WHEN outcome = 'applied' THEN kind = 'delete' OR (deleted AND kind <> 'restore') ELSE deleted END, CASE WHEN outcome = 'applied' THEN list_append(past, nh) ELSE past END
  FROM (SELECT *, CASE WHEN kind = 'create' THEN CASE WHEN version > 0 THEN 'rejected' ELSE 'applied' END WHEN version = 0 THEN 'rejected'
          WHEN (kind = 'delete' AND deleted) OR (kind = 'restore' AND NOT deleted) THEN 'unchanged'
          WHEN NOT ((bv IS NULL AND bh IS NULL) OR (bv = version AND bh IS NOT DISTINCT FROM h) IS TRUE) THEN 'stale'
          WHEN kind IN ('update', 'revert') THEN CASE WHEN deleted OR nh IS NULL THEN 'rejected' WHEN nh = h THEN 'unchanged' ELSE 'applied' END ELSE 'applied' END AS outcome
        FROM (SELECT s.entity_id, m.n, m.op_id, s.version, s.h, s.deleted, s.past, m.kind, m.bv, m.bh,
                CASE m.kind WHEN 'create' THEN c WHEN 'update' THEN c WHEN 'revert' THEN s.past[m.to_version] ELSE s.h END AS nh FROM s JOIN m ON m.entity_id = s.entity_id AND m.n = s.n + 1))
)
SELECT entity_id, op_id, outcome, version, h AS content_hash, deleted FROM s WHERE n > 0
""")
def lifecycle_fold_based(spark, d):
    """Operations with the bases that a fold without them predicts, some of them stale, and reverts."""
    log = T.log(spark, d).select("entity_id", "op_id", "kind", "content_hash")
    blank = log.withColumns({"base_version": F.lit(None).cast("long"), "base_hash": F.lit(None).cast("string"), "to_version": F.lit(None).cast("long")})
    free = versions.fold(blank).select("entity_id", "op_id", "outcome", F.col("version").alias("_v"), F.col("content_hash").alias("_h"))
    w = Window.partitionBy("entity_id").orderBy("op_id")
    p = log.join(free, ["entity_id", "op_id"]).withColumns({"v": F.coalesce(F.lag("_v").over(w), F.lit(0)), "h": F.lag("_h").over(w)})
    n = F.col("op_id")
    stale = (n % 11 == 0) & ((F.col("outcome") != "applied") | (F.col("entity_id") % 5 == 0))
    based = (F.col("kind") != "create") & (n % 3 != 0)
    return versions.fold(
        p.select(
            "entity_id", "op_id", "content_hash", F.when((F.col("kind") == "update") & (n % 13 == 0), "revert").otherwise(F.col("kind")).alias("kind"),
            F.when(based, F.col("v") - stale.cast("int")).alias("base_version"), F.when(based, F.col("h")).alias("base_hash"), (n % 5 + 1).alias("to_version"),
        )
    )


# --- filtered search on an index ---------------------------------------------------------------


@query(ORACLE_SQL["search_phrase_filtered"])
def search_filtered_on_index(spark, d):
    """The flagship search, its phrase from a stored index that has taken in a third of the rows as a change."""
    docs = T.documents(spark, d).select("doc_id", "text", "source", "lang", "n_chars")
    stored = StoredIndex(spark, passing_folder(spark), {"text": F.coalesce("text", F.lit(""))}, "doc_id")
    stored.build(docs.where("doc_id % 3 <> 0"))
    stored.apply(docs.where("doc_id % 3 = 0"))
    hits = stored.search(docs, "of the", {"lang": ["en", "fr"]})
    rows = hits.join(T.read(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source", "n_chars")
    return search.page(rows, [F.desc("n_chars"), F.desc("doc_id")])


# --- the pull cycle ----------------------------------------------------------------------------


@query(f"SELECT CAST(entity_id AS VARCHAR) AS entity_id, sequence, version, content_hash FROM ({CHANGES}) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC, sequence) = 1")
def pull_cycle_baseline(spark, d):
    """The stored baseline after three pages, the second of them twice."""
    changes = T.log(spark, d).select(
        F.col("op_id").alias("sequence"), F.lit("question").alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"), (F.col("op_id") % 40 + 1).alias("version"), "content_hash"
    )
    last = changes.agg(F.max("sequence")).first()[0]
    pages = [changes.where(F.floor(3 * F.col("sequence") / (last + 1)) == k) for k in range(3)]
    path = passing_folder(spark)
    for number, page in enumerate((pages[0], pages[1], pages[1], pages[2])):
        cycle.merge(page, path, ("feed", number))
    return cycle.stored(spark, path).select("entity_id", "sequence", "version", "content_hash")


@query(f"""
WITH RECURSIVE ev AS (SELECT user_id AS e, event_id AS seq, event_id % 2 = 0 AS remote, 'o' || event_id AS op, {KIND} AS kind, 1 + event_id % 400 AS v, 'h' || event_id % 4 AS h,
    event_id % 7 AS bv, 'h' || event_id % 3 AS bh, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (
  SELECT DISTINCT e, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, false AS remote, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS operation_id,
    CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BOOLEAN) AS base_known, CAST(NULL AS BIGINT) AS cv, CAST(NULL AS VARCHAR) AS ch, CAST([] AS STRUCT(op VARCHAR, h VARCHAR, bv BIGINT, bh VARCHAR)[]) AS waiting FROM ev
  UNION ALL
  SELECT e, n, seq, remote, outcome, CASE WHEN outcome = 'applied' AND top IS NOT NULL THEN CASE WHEN top.h = h THEN 'settle' ELSE 'conflict' END END,
    CASE WHEN outcome = 'applied' THEN top.op END, CASE WHEN outcome = 'applied' AND top.h <> h THEN CASE WHEN kind = 'delete' THEN 'tombstoneDivergence' ELSE 'divergentContent' END END,
    CASE WHEN outcome = 'applied' AND top.h <> h THEN coalesce(cv = top.bv AND ch = top.bh, false) END,
    CASE WHEN outcome = 'applied' THEN v ELSE cv END, CASE WHEN outcome = 'applied' THEN h ELSE ch END,
    CASE WHEN NOT remote THEN list_append(waiting, own) WHEN outcome = 'applied' AND top.h = h THEN waiting[1 : len(waiting) - 1] ELSE waiting END
  FROM (SELECT s.e, ev.n, ev.seq, ev.remote, ev.kind, ev.v, ev.h, s.cv, s.ch, s.waiting, s.waiting[len(s.waiting)] AS top, struct_pack(op := ev.op, h := ev.h, bv := ev.bv, bh := ev.bh) AS own,
          CASE WHEN NOT ev.remote THEN NULL WHEN s.cv > ev.v OR (s.cv = ev.v AND s.ch = ev.h) THEN 'ignored' WHEN s.cv = ev.v THEN 'corrupt' ELSE 'applied' END AS outcome
        FROM s JOIN ev ON ev.e = s.e AND ev.n = s.n + 1)
)
SELECT e AS entity_id, seq AS "at", outcome, decision, operation_id, reason, base_known FROM s WHERE remote
""")
def remote_against_queue(spark, d):
    """Remote changes and local operations as one keyed state: what each change does."""
    n = F.col("op_id")
    tag = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    events = T.log(spark, d).select(
        F.lit("question").alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"), n.alias("at"), F.when(n % 2 == 0, "remote").otherwise("local").alias("side"),
        tag("o", n).alias("operation_id"), "kind", (1 + n % 400).alias("version"), (n % 7).alias("base_version"), tag("h", n % 3).alias("base_hash"), tag("h", n % 4).alias("content_hash"),
    )
    return exchange.received(events).select(F.col("entity_id").cast("long").alias("entity_id"), "at", "outcome", "decision", "operation_id", "reason", "base_known")


# --- the queue ---------------------------------------------------------------------------------

EDGES = """SELECT event_id AS a, unnest(list_distinct(list_concat(CASE WHEN event_id > 0 THEN [event_id // 4, event_id // 5] ELSE [] END,
  CASE WHEN event_id % 500 = 407 THEN [event_id + 1] WHEN event_id % 500 = 408 THEN [event_id - 1] ELSE [] END, CASE WHEN event_id % 701 = 300 THEN [-1 - event_id] ELSE [] END))) AS b FROM events"""


@query(f"""
WITH RECURSIVE e AS ({EDGES}), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
missing AS (SELECT DISTINCT a FROM e WHERE b NOT IN (SELECT event_id FROM events)), cyclic AS (SELECT DISTINCT a FROM reach WHERE a = b),
bad AS (SELECT a FROM missing UNION SELECT a FROM cyclic UNION SELECT r.a FROM reach r WHERE r.b IN (SELECT a FROM missing UNION SELECT a FROM cyclic)),
lv AS (SELECT event_id AS a, 0 AS l FROM events WHERE event_id NOT IN (SELECT a FROM e) UNION SELECT e.a, l + 1 FROM lv JOIN e ON e.b = lv.a WHERE e.a NOT IN (SELECT a FROM bad))
SELECT event_id AS operation_id, (SELECT max(l) FROM lv WHERE lv.a = event_id) AS level,
  CASE WHEN event_id IN (SELECT a FROM missing) THEN 'missing' WHEN event_id IN (SELECT a FROM cyclic) THEN 'cycle' WHEN event_id IN (SELECT a FROM bad) THEN 'blocked' END AS problem
FROM events
""")
def dependency_levels(spark, d):
    n = F.col("event_id")
    none = F.array().cast("array<bigint>")
    some = lambda when, *x: F.when(when, F.array(*x)).otherwise(none)
    deps = F.concat(
        some(n > 0, F.expr("event_id div 4"), F.expr("event_id div 5")), some(n % 500 == 407, n + 1), some(n % 500 == 408, n - 1), some(n % 701 == 300, -1 - n)
    )
    bound = T.read(spark, d, "events").select(n.alias("operation_id"), deps.alias("dependencies"))
    return dependencies.levels(bound, dependencies.edges(bound))


@query(f"""
SELECT event_id AS operation_id, CASE WHEN event_id % 17 = 0 THEN 'selfDependency' WHEN user_id % 3 = 1 AND user_id % 5 = 2 THEN 'unregistered'
  WHEN {STATE} NOT IN ('pending', 'retrying') THEN 'notFound' ELSE 'bound' END AS outcome FROM events
""")
def queue_binding(spark, d):
    e, n, u = T.read(spark, d, "events"), F.col("event_id"), F.col("user_id")
    name = [F.concat(F.lit("a"), (u % 3).cast("string")).alias("account_id"), F.concat(F.lit("d"), (u % 5).cast("string")).alias("device_id")]
    devices = e.where("not (user_id % 3 = 1 and user_id % 5 = 2)").select(*name).distinct()
    requests = e.select(n.alias("operation_id"), *name, F.array(F.when(n % 17 == 0, n).otherwise(n - 1)).alias("dependencies"))
    return dependencies.bind(T.queue(spark, d), devices, requests).select("operation_id", "outcome")


SETTLED = """SELECT event_id, 'o' || event_id AS op, user_id, props, 'n' || event_id AS cid, 1 + event_id % 40 AS version, sha256(props) AS hash,
  CASE event_type WHEN 'signup' THEN 'noop' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'conflict' ELSE 'applied' END AS status,
  CASE WHEN event_id % 2 = 0 THEN 's' || event_id ELSE 'push' END AS cursor FROM events WHERE event_id % 3 = 1"""


@query(f"""
WITH o AS ({SETTLED}), s AS (SELECT *, CASE status WHEN 'conflict' THEN 'conflict' WHEN 'rejected' THEN 'failed' ELSE 'settled' END AS state FROM o)
SELECT 'queue' AS name, op AS key, state || coalesce(CASE state WHEN 'conflict' THEN '/SYNC_CONFLICT' WHEN 'failed' THEN '/SYNC_OPERATION_FAILED' END, '') AS value FROM s
UNION ALL SELECT 'journal', op, CASE WHEN event_id % 2 = 0 THEN '{{"changeCursor":"' || cursor || '"}}' ELSE '{{}}' END FROM s
UNION ALL SELECT 'conflicts', cid, op || '/' || version || '/' || hash FROM s WHERE state = 'conflict'
UNION ALL SELECT 'baseline', CAST(user_id AS VARCHAR), arg_max(version || '/' || hash || '/' || cursor, (version, op)) FROM s WHERE state = 'settled' GROUP BY user_id
UNION ALL SELECT 'queue', 'o' || event_id, 'in_flight' FROM events WHERE event_id % 3 <> 1
""")
def settled_batch(spark, d):
    """Journal, queue, conflicts and baseline after a third of the queue is settled as one batch, and settled again."""
    e, n = T.read(spark, d, "events"), F.col("event_id")
    kind = T.log(spark, d).select(F.col("op_id").alias("event_id"), "kind")
    op = F.concat(F.lit("o"), n.cast("string"))
    queue = e.join(kind, "event_id").select(
        op.alias("operation_id"), F.lit("question").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), "kind", (n % 40).alias("base_version"), F.sha2("props", 256).alias("base_hash"),
        F.col("props").alias("payload"), F.array().cast("array<string>").alias("depends_on"), F.concat(F.lit("b"), (n % 3).cast("string")).alias("batch_id"), F.lit("in_flight").alias("state"),
        F.lit(None).cast("string").alias("error_code"), F.lit(0).cast("long").alias("updated_at"),
    )
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "noop", "error": "rejected", "purchase": "conflict"}.items() for x in kv])
    outcomes = e.where("event_id % 3 = 1").select(
        op.alias("operation_id"), F.coalesce(kinds[F.col("event_type")], F.lit("applied")).alias("status"), (n % 40 + 1).alias("entity_version"), F.sha2("props", 256).alias("content_hash"),
        F.concat(F.lit("n"), n.cast("string")).alias("conflict_id"),
        F.when(n % 2 == 0, F.concat(F.lit('{"changeCursor": "s'), n.cast("string"), F.lit('"}'))).otherwise("{}").alias("response"),
    )
    kept = settle.Exchanged(spark, passing_folder(spark))
    kept.enqueue(queue)
    kept.settle("b1", outcomes, NOW)
    kept.settle("b1", outcomes, NOW + 1)
    row = lambda name, key, *value: kept.table(name).select(F.lit(name).alias("name"), F.col(key).alias("key"), F.concat_ws("/", *value).alias("value"))
    parts = [row("queue", "operation_id", "state", "error_code"), row("journal", "operation_id", "response"), row("conflicts", "conflict_id", "operation_id", "cloud_version", "cloud_hash")]
    return parts[0].union(parts[1]).union(parts[2]).union(row("baseline", "entity_id", "version", "content_hash", "sequence"))


# --- blobs, images, folders and links ----------------------------------------------------------


@query("""
SELECT doc_id AS upload_id, sha256(t) AS blob_hash, octet_length(encode(t)) AS byte_size, CASE WHEN nth = 1 AND NOT there THEN 'stored' ELSE 'duplicate' END AS outcome
FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY t, doc_id % 5 = 0 ORDER BY CAST(doc_id AS VARCHAR)) AS nth, bool_or(doc_id % 5 = 0) OVER (PARTITION BY t) AS there
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
WHERE doc_id % 5 <> 0
""")
def blob_uploads(spark, d):
    """Texts uploaded in chunks of 1,000 bytes to a store that has every fifth of them."""
    docs = T.documents(spark, d).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    size = F.greatest(F.ceil(F.octet_length("data") / 1000), F.lit(1)).cast("int")
    at = F.explode(F.sequence(F.lit(0), size - 1))
    chunks = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("upload_id"), "data", at.alias("chunk"))
    chunks = chunks.withColumn("data", F.substr("data", F.col("chunk") * 1000 + 1, F.lit(1000)))
    store = BlobStore(spark, passing_folder(spark))
    store.put(docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("upload_id"), "data"))
    return store.put(chunks).select(F.col("upload_id").cast("long").alias("upload_id"), "blob_hash", "byte_size", "outcome")


@query("""
WITH a AS (SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place, sha256(p_name) AS blob_hash,
    CASE WHEN p_size = 7 THEN 'image/webp' WHEN l_suppkey % 29 = 0 THEN 'image/gif' ELSE 'image/png' END AS media_type, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT sha256(p_name) AS blob_hash, bool_or(p_size % 9 = 0) AS gone, bool_or(p_size % 9 = 1) AS changed FROM part GROUP BY 1),
o AS (SELECT paper_id, blob_hash, min(place) AS place, min(media_type) AS media_type, count(DISTINCT media_type) AS kinds FROM a GROUP BY 1, 2)
SELECT paper_id, blob_hash, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY place) AS INTEGER) AS number,
  CASE WHEN kinds > 1 THEN 'the same blob hash has conflicting media types' WHEN media_type = 'image/webp' THEN 'only supported raster image media types can be exported'
       WHEN gone THEN 'missing blob' WHEN changed THEN 'blob content does not match its declared SHA-256 hash' END AS error
FROM o LEFT JOIN b USING (blob_hash)
""")
def paper_pictures(spark, d):
    """The images of papers, numbered, with what is wrong with them."""
    li = T.read(spark, d, "lineitem").join(T.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    media = F.when(F.col("p_size") == 7, "image/webp").when(F.col("l_suppkey") % 29 == 0, "image/gif").otherwise("image/png")
    image = F.struct(F.sha2("p_name", 256).alias("blob_hash"), media.alias("media_type"), F.col("p_name").alias("caption"))
    items = li.select(F.col("l_orderkey").alias("paper_id"), F.row_number().over(w).alias("place"), F.array(image).alias("attachments"))
    named = T.read(spark, d, "part").groupBy("p_name").agg(F.max(F.col("p_size") % 9 == 0).alias("gone"), F.max(F.col("p_size") % 9 == 1).alias("changed"))
    content = F.when(F.col("changed"), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    blobs = named.where("not gone").select(F.sha2("p_name", 256).alias("blob_hash"), F.encode(content, "UTF-8").alias("content"))
    return export.pictures(items, blobs).select("paper_id", "blob_hash", "number", "error")


@query(r"""
WITH f AS (SELECT list_filter(string_split_regex(regexp_replace(coalesce(url, ''), '^[a-z]+:/*', ''), '/+'), lambda x, i: true) AS p, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
a AS (SELECT array_to_string(p[1 : k], '/') AS folder, n FROM (SELECT p, n, unnest(range(0, len(p))) AS k FROM f))
SELECT folder, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM a GROUP BY folder
""")
def folder_totals(spark, d):
    """Pages as files below their host: what each folder holds in all."""
    path = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+:/*", "")
    files = T.read(spark, d, "pages").select(path.alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    return inventory.folder_sizes(files).select("folder", "files", F.col("bytes").cast("long").alias("bytes"))


LINKED = """
SELECT event_id AS attachment_id, CASE event_id % 4 WHEN 0 THEN 'question' WHEN 1 THEN 'paper' WHEN 2 THEN 'draft' ELSE 'comment' END AS kind, user_id AS target,
  'w' || event_id % 2 AS owner, CASE WHEN event_id % 9 = 0 THEN 'local' ELSE 'cloud' END AS scope, event_id % 31 = 0 AS gone FROM events WHERE event_id % 37 <> 5"""


@query(f"""
WITH a AS ({LINKED}), l AS (SELECT event_id AS attachment_id, CASE event_id % 4 WHEN 0 THEN 'question' WHEN 1 THEN 'paper' WHEN 2 THEN 'draft' ELSE 'comment' END AS target_type,
    CASE WHEN event_id % 23 = 0 THEN user_id + 1 ELSE user_id END AS target_id FROM events UNION ALL SELECT event_id, 'comment', user_id FROM events WHERE event_id % 50 = 2),
t AS (SELECT DISTINCT user_id AS id, 'w' || user_id % 2 AS owner, CASE WHEN user_id % 9 = 0 THEN 'local' ELSE 'cloud' END AS scope, user_id % 31 = 0 AS gone FROM events WHERE user_id % 41 <> 0),
k AS (SELECT attachment_id, count(DISTINCT target_type) AS kinds FROM l GROUP BY 1)
SELECT l.attachment_id, l.target_type, l.target_id, CASE WHEN a.attachment_id IS NULL THEN 'no attachment' WHEN a.kind <> l.target_type OR a.target <> l.target_id THEN 'another target' WHEN t.id IS NULL THEN 'no target'
  WHEN a.gone OR t.gone THEN 'deleted' WHEN a.owner <> t.owner THEN 'another owner' WHEN a.scope <> t.scope THEN 'another scope' WHEN kinds > 1 THEN 'linked elsewhere' END AS error
FROM l LEFT JOIN a USING (attachment_id) LEFT JOIN t ON t.id = l.target_id JOIN k USING (attachment_id)
""")
def attachment_link_rules(spark, d):
    e, n, u = T.read(spark, d, "events"), F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.array(*map(F.lit, inventory.TARGETS)), (n % 4 + 1).cast("int"))
    owner, scope = (lambda x: F.concat(F.lit("w"), (x % 2).cast("string")).alias("owner_id")), (lambda x: F.when(x % 9 == 0, "local").otherwise("cloud").alias("scope"))
    gone = lambda x: F.when(x % 31 == 0, F.lit(1)).alias("deleted_at")
    attachments = e.where("event_id % 37 <> 5").select(n.alias("attachment_id"), kind.alias("target_type"), u.alias("target_id"), owner(n), scope(n), gone(n))
    links = e.select(n.alias("attachment_id"), kind.alias("target_type"), F.when(n % 23 == 0, u + 1).otherwise(u).alias("target_id"))
    links = links.union(e.where("event_id % 50 = 2").select(n, F.lit("comment"), u))
    users = e.where("user_id % 41 <> 0").select(u).distinct()
    targets = users.select(F.explode(F.array(*map(F.lit, inventory.TARGETS))).alias("target_type"), u.alias("target_id"), owner(u), scope(u), gone(u))
    return inventory.link_errors(links, attachments, targets)


@query("""
SELECT c_nationkey AS account_id, c_custkey AS device_id, c_mktsegment AS state, s_acctbal > 0 AS ready FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey
""")
def device_states(spark, d):
    devices = T.read(spark, d, "customer").select(F.col("c_nationkey").alias("account_id"), F.col("c_custkey").alias("device_id"), F.col("c_mktsegment").alias("state"))
    runtime = T.read(spark, d, "supplier").select(F.col("s_nationkey").alias("account_id"), F.col("s_suppkey").alias("device_id"), (F.col("s_acctbal") > 0).alias("ready"))
    return inventory.device_states(devices, runtime)


@query("""
SELECT event_id AS attachment_id, sha256('{"blobHash":"' || sha256(props) || '","byteSize":' || octet_length(encode(props)) || ',"caption":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"c' || event_id % 5 || '"' END
  || ',"entity":"attachment","fileName":"' || event_type || '.png","mediaType":"image/png","position":' || event_id % 4 || ',"schemaVersion":1,"targetId":"q' || user_id || '","targetType":"question"}') AS content_hash FROM events
""")
def attachment_hashes(spark, d):
    n = F.col("event_id")
    tag = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    rows = T.read(spark, d, "events").select(
        n.alias("attachment_id"), F.lit("question").alias("target_type"), tag("q", F.col("user_id")).alias("target_id"), F.concat("event_type", F.lit(".png")).alias("file_name"),
        F.lit("image/png").alias("media_type"), F.octet_length("props").alias("byte_size"), F.sha2("props", 256).alias("blob_hash"), F.when(n % 3 != 0, tag("c", n % 5)).alias("caption"), (n % 4).alias("position"),
    )
    return rows.select("attachment_id", inventory.attachment_hash().alias("content_hash"))

"""Registered queries over the driver's tables; each has its SQL beside it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import scalars as S
from ..operators import changes, export, generate, inventory, outbox, papers, search, versions
from ..operators.search_index import StoredIndex
from ..sources.shared import passing_folder, spread
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KIND = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'restore' ELSE 'update' END"
STATE = (
    "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'retrying' WHEN 'view' THEN 'settled' "
    "WHEN 'error' THEN 'failed' ELSE 'conflict' END"
)
LOG = f"SELECT event_id AS op_id, user_id AS entity_id, ts AS changed_at, {KIND} AS kind, {STATE} AS state, props, value, sha256(props) AS content_hash FROM events"
HISTORY = f"SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY changed_at, op_id) AS version FROM ({LOG})"
TOKENS = "' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- search -------------------------------------------------------------------------------------


@query(f"""
SELECT doc_id, source, n_chars FROM documents d
WHERE lang IN ('en', 'fr') AND contains({TOKENS}, ' of the ')
  AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
ORDER BY n_chars DESC, doc_id DESC LIMIT 51
""")
def search_phrase_filtered(spark, d):
    bank = spread(T.documents(spark, d).select("doc_id", "text", "source", "lang", "n_chars"))
    hits = search.search(bank, "of the", ["text"], {"lang": ["en", "fr"]})
    labelled = T.read(spark, d, "labels").where("quality = 1")
    rows = hits.join(labelled, "doc_id", "left_semi").select("doc_id", "source", "n_chars")
    return search.page(rows, [F.desc("n_chars"), F.desc("doc_id")])


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 51 OFFSET 50")
def search_page_two(spark, d):
    rows = T.documents(spark, d).select("doc_id", "lang", "n_chars")
    return search.page(rows, [F.desc("n_chars"), F.desc("doc_id")], cursor=search.encode_cursor(50))


@query("SELECT p_partkey AS id, p_name AS text FROM part WHERE list_has_any(string_split(p_name, ' '), ['blue', 'red'])")
def search_any_tag(spark, d):
    return search.search(T.questions(spark, d), relations={"tags": ["blue ", "red", " "]}).select("id", "text")


@query(f"""
WITH t AS (SELECT doc_id, string_split(trim({TOKENS}), ' ') AS w, text FROM documents),
c AS (SELECT doc_id, CASE WHEN trim({TOKENS}) = '' THEN 0 ELSE len(w) END AS n,
             len(list_filter(w, lambda x: x = 'with')) AS a, len(list_filter(w, lambda x: x = 'this')) AS b FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m))
     + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score
FROM c, s WHERE a > 0 OR b > 0
""")
def search_ranked(spark, d):
    found = search.bm25(spread(T.documents(spark, d).select("doc_id", "text")), ["with", "this"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


# The fields are text, source and lang, as a bank's text, source and one tag; "size" counts the tokens of all.
RANKED = f"""
WITH t AS (SELECT *, list_filter(string_split({TOKENS}, ' '), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, source, lang, n_chars, len(w) + 2 AS size,
             len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS hits FROM t),
s AS (SELECT count(*) AS docs, avg(size) AS m, count(*) FILTER (hits > 0) AS held FROM h)
SELECT doc_id, source, n_chars, round(-greatest(ln((docs - held + 0.5) / (held + 0.5)), 0.000001) * hits * 2.2
     / (hits + 1.2 * (0.25 + 0.75 * size / m)), 9) AS score
FROM h d, s WHERE hits > 0
"""


@query(f"""
SELECT * FROM ({RANKED} AND lang IN ('en', 'fr') AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1))
ORDER BY score, n_chars DESC, doc_id DESC LIMIT 51
""")
def search_ranked_page(spark, d):
    """One search: phrase, filters, a relation, relevance and a page."""
    bank = spread(T.documents(spark, d).select("doc_id", "text", "source", F.array("lang").alias("tags"), "lang", "n_chars"))
    hits = search.ranked(bank, "doc_id", search.document_fields(subjects=None), "of the")
    hits = search.search(hits, values={"lang": ["en", "fr"]}).join(T.read(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    rows = hits.select("doc_id", "source", "n_chars", F.round("score", 9).alias("score"))
    return search.page(rows, [F.asc("score"), F.desc("n_chars"), F.desc("doc_id")])


@query(f"SELECT doc_id, score FROM ({RANKED})")
def search_index_hits(spark, d):
    """The same phrase through the inverted index."""
    bank = spread(T.documents(spark, d).select("doc_id", "text", "source", F.array("lang").alias("tags")))
    fields = search.document_fields(subjects=None)
    found = search.index(bank, "doc_id", fields)
    return search.ranked(bank, "doc_id", fields, "of the", found).select("doc_id", F.round("score", 9).alias("score"))


@query(f"SELECT doc_id, score FROM ({RANKED})")
def search_stored_index(spark, d):
    """The same phrase through a stored index that has followed the bank: other texts, missing and surplus rows at first."""
    bank = T.documents(spark, d).select("doc_id", "text", "source", F.array("lang").alias("tags"))
    k = F.col("doc_id") % 4
    first = bank.where(k != 0).withColumn("text", F.when(k == 1, F.concat(F.lit("of the of the "), "text")).otherwise(F.col("text")))
    surplus = bank.where(k == 2).withColumn("doc_id", -F.col("doc_id") - 1)
    stored = StoredIndex(spark, passing_folder(spark), search.document_fields(subjects=None), "doc_id")
    stored.build(first.union(surplus))
    stored.apply(bank.where(k == 0), surplus.where("doc_id % 8 = -3"))
    stored.apply(bank.where(k == 1), surplus)
    return stored.ranked(bank, "of the").select("doc_id", F.round("score", 9).alias("score"))


@query("""
SELECT p_partkey AS id, 'tag' AS relation, CAST(i - 1 AS INTEGER) AS position, tags[i] AS value
FROM (SELECT p_partkey, string_split(p_name, ' ') AS tags FROM part), range(1, 20) r(i) WHERE i <= len(tags)
UNION ALL SELECT p_partkey, 'subject', 0, p_brand FROM part
""")
def subject_tag_projection(spark, d):
    q = T.questions(spark, d)
    tags = q.select("id", F.lit("tag").alias("relation"), F.posexplode("tags").alias("position", "value"))
    return tags.union(q.select("id", F.lit("subject").alias("relation"), F.posexplode("subjects").alias("position", "value")))


# --- hashes and scalars ------------------------------------------------------------------------


@query("""
SELECT p_partkey AS id, sha256('{"entity":"question","schemaVersion":1,"size":' || p_size || ',"subjects":["' || p_brand
       || '"],"text":"' || p_name || '"}') AS content_hash FROM part
""")
def content_hash(spark, d):
    p = T.read(spark, d, "part")
    content = F.struct(F.col("p_name").alias("text"), F.col("p_size").alias("size"), F.array("p_brand").alias("subjects"))
    return p.select(F.col("p_partkey").alias("id"), canonical.content_hash("question", 1, content).alias("content_hash"))


@query("""
SELECT p_partkey AS id, w AS raw, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE
  regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR), '\\.?0+$', '') END AS score_weight
FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN '-1' ELSE ' ' || CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR) || ' ' END AS w FROM part)
""")
def normalize_score_weight(spark, d):
    p = T.read(spark, d, "part")
    price = F.concat(F.lit(" "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit(" "))
    raw = F.when(F.col("p_partkey") % 5 == 0, "-1").otherwise(price)
    return p.select(F.col("p_partkey").alias("id"), raw.alias("raw"), S.score_weight(raw).alias("score_weight"))


@query("""
WITH r AS (SELECT p_partkey AS id, replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN ';' WHEN 1 THEN ' , ' ELSE '|' END) || ';;' AS raw,
  CASE p_partkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN '0' WHEN 2 THEN 'N' ELSE 'maybe' END AS flag FROM part)
SELECT id, array_to_string(list_distinct_ordered, '/') AS parsed,
  CASE WHEN lower(trim(flag)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(flag)) IN ('false', '0', 'no', 'n') THEN false END AS flag
FROM (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered
      FROM (SELECT *, list_filter(list_transform(string_split_regex(raw, '[;,|]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM r))
""")
def parse_list_and_flag(spark, d):
    p = T.read(spark, d, "part")
    sep = F.when(F.col("p_partkey") % 3 == 0, ";").when(F.col("p_partkey") % 3 == 1, " , ").otherwise("|")
    flag = F.element_at(F.array(*map(F.lit, (" Yes", "0", "N", "maybe"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.concat(F.replace("p_name", F.lit(" "), sep), F.lit(";;"))
    return p.select(
        F.col("p_partkey").alias("id"), F.array_join(S.parse_list(raw), "/").alias("parsed"), S.tri_bool(flag).alias("flag")
    )


@query("SELECT doc_id, length(text) - length(replace(text, '$', '')) >= 2 AS has_latex FROM documents")
def detect_latex(spark, d):
    return T.documents(spark, d).select("doc_id", S.has_math(F.col("text")).alias("has_latex"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size >= 24 THEN 'dense' WHEN p_size >= 14 THEN 'compact' ELSE 'normal' END AS density,
  chr(CAST(65 + p_size % 26 AS INTEGER)) AS label, replace(p_name, ' ', ' &amp; ') AS xml,
  CASE WHEN p_size % 2 = 0 THEN 'E_' || p_size ELSE 'SYNC_REMOTE_FAILURE' END AS code,
  1000000 * CAST(power(2, least(p_size - 1, 8)) AS BIGINT) AS backoff,
  regexp_matches(CAST(p_retailprice AS VARCHAR), '^(0|[1-9][0-9]*)([.][0-9]*[1-9])?$') AS canonical, p_name || '.tex' AS filename
FROM part
""")
def export_scalars(spark, d):
    p = T.read(spark, d, "part")
    code = F.concat(F.when(F.col("p_size") % 2 == 0, "E_").otherwise("e-"), F.col("p_size").cast("string"))
    return p.select(
        F.col("p_partkey").alias("id"),
        S.density(F.col("p_size")).alias("density"),
        S.option_label(F.col("p_size") % 26).alias("label"),
        S.xml_escape(F.replace("p_name", F.lit(" "), F.lit(" & "))).alias("xml"),
        S.error_code(code).alias("code"),
        S.backoff_micros(F.col("p_size")).alias("backoff"),
        S.is_canonical_decimal(F.col("p_retailprice").cast("string")).alias("canonical"),
        S.safe_filename(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" : "))), "tex").alias("filename"),
    )


# --- inventory ---------------------------------------------------------------------------------


@query("SELECT sha256(text) AS blob_hash, octet_length(encode(text)) AS byte_size, count(*) AS uses FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_blobs(spark, d):
    files = T.documents(spark, d).select(F.sha2("text", 256).alias("blob_hash"), F.octet_length("text").cast("long").alias("byte_size"))
    return inventory.blobs(files).where("uses > 1")


@query("SELECT sha256(text) AS blob_hash, count(DISTINCT source || '/' || lang) AS descriptions FROM documents GROUP BY 1 HAVING count(DISTINCT source || '/' || lang) > 1")
def blob_conflicts(spark, d):
    files = T.documents(spark, d).select(F.sha2("text", 256).alias("blob_hash"), "source", "lang")
    return inventory.blob_conflicts(files, "source", "lang")


COUNTED = ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS live FROM {t}" + (" WHERE p_size % 10 <> 0" if t == "part" else "") for t in COUNTED))
def live_counts(spark, d):
    tables = {t: T.read(spark, d, t) for t in COUNTED}
    tables["part"] = tables["part"].withColumn("deleted_at", F.when(F.col("p_size") % 10 == 0, F.lit(1)))
    return inventory.live_counts(tables)


@query("SELECT paper_id, n FROM (SELECT l_orderkey AS paper_id, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n > 2")
def repeated_positions(spark, d):
    return inventory.repeated(T.items(spark, d), "paper_id", "item_order").where("n > 2").select("paper_id", "n")


@query("SELECT l_orderkey AS paper_id, l_partkey AS question_id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def integrity_fk(spark, d):
    live = T.read(spark, d, "part").where("p_size > 10")
    return inventory.missing_references(T.items(spark, d), live, "question_id", "p_partkey").select("paper_id", "question_id")


@query("""
SELECT l_orderkey AS paper_id, l_linenumber - 1 AS item_order, l_partkey AS question_id FROM lineitem
JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = l_linestatus JOIN part ON l_partkey = p_partkey
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 0)
""")
def link_guard(spark, d):
    li = T.read(spark, d, "lineitem")
    orders, part, supplier = (T.read(spark, d, t) for t in ("orders", "part", "supplier"))
    rows = li.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("o_orderstatus") == F.col("l_linestatus")))
    rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(supplier.where("s_acctbal < 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    return rows.select(F.col("l_orderkey").alias("paper_id"), (F.col("l_linenumber") - 1).alias("item_order"), F.col("l_partkey").alias("question_id"))


@query("SELECT event_id AS backup_id FROM events WHERE event_type <> 'view' AND value > 20 AND user_id % 2 = 0 AND epoch_us(ts) < 1704585600000000")
def retention_candidates(spark, d):
    e = T.read(spark, d, "events").select(
        F.col("event_id").alias("backup_id"),
        (F.col("event_type") != "view").alias("automatic"),
        (F.col("value") > 20).alias("verified"),
        F.concat(F.lit("w"), (F.col("user_id") % 2).cast("string")).alias("workspace_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"),
    )
    return inventory.retention(e, "w0", 1704585600000000).select("backup_id")


@query("""
WITH u AS (SELECT l_orderkey AS upload_id, max(l_linenumber) AS chunks FROM lineitem GROUP BY 1),
got AS (SELECT DISTINCT l_orderkey AS upload_id, l_linenumber - 1 AS chunk FROM lineitem WHERE l_returnflag <> 'R')
SELECT u.upload_id, chunks, (SELECT count(*) FROM got g WHERE g.upload_id = u.upload_id) AS received,
  coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM range(0, 20) r(i) WHERE i < chunks
            AND NOT EXISTS (SELECT 1 FROM got g WHERE g.upload_id = u.upload_id AND g.chunk = i)), '') AS missing
FROM u
""")
def chunk_completeness(spark, d):
    li = T.read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "upload_id")
    uploads = li.groupBy("upload_id").agg(F.max("l_linenumber").alias("chunks"))
    got = li.where("l_returnflag <> 'R'").select("upload_id", (F.col("l_linenumber") - 1).alias("chunk"))
    found = inventory.missing_chunks(uploads, got)
    return found.withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ",")).withColumn("received", F.col("received").cast("long"))


# --- queue -------------------------------------------------------------------------------------


@query(f"SELECT {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ('pending', 'retrying', 'conflict', 'failed'))} FROM ({LOG})")
def queue_state_counts(spark, d):
    return outbox.state_counts(T.queue(spark, d))


@query(f"SELECT entity_id, arg_max(state, (changed_at, op_id)) AS status FROM ({LOG}) WHERE state <> 'settled' GROUP BY 1")
def latest_entity_state(spark, d):
    return outbox.latest_states(T.queue(spark, d), "entity_id")


@query(f"SELECT 'E_' || op_id % 7 AS error_code FROM ({LOG}) WHERE state = 'failed' ORDER BY changed_at DESC, op_id DESC LIMIT 1")
def last_error(spark, d):
    return outbox.last_error(T.queue(spark, d))


@query(f"""
SELECT op_id AS operation_id, entity_id FROM ({LOG}) WHERE state IN ('pending', 'retrying') AND op_id % 5 <> 0
  AND (op_id % 4 <> 0 OR epoch_us(changed_at) <= 1704585600000000) ORDER BY changed_at, op_id LIMIT 100
""")
def eligible_batch(spark, d):
    return outbox.eligible(T.queue(spark, d), "owner", 1704585600000000).select("operation_id", "entity_id")


@query(f"SELECT op_id AS operation_id, entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY changed_at, op_id) - 1 AS INTEGER) AS batch_ordinal FROM ({LOG})")
def batch_ordinals(spark, d):
    return outbox.ordinals(T.queue(spark, d), "entity_id").select("operation_id", "entity_id", "batch_ordinal")


@query(f"""
WITH b AS (SELECT entity_id, version, content_hash FROM ({HISTORY}) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) = 1),
q AS (SELECT op_id, entity_id, content_hash, changed_at, row_number() OVER w AS n, lag(content_hash) OVER w AS ph, lag(op_id) OVER w AS po
      FROM ({LOG}) WHERE state IN ('pending', 'retrying') WINDOW w AS (PARTITION BY entity_id ORDER BY changed_at, op_id))
SELECT op_id AS operation_id, q.entity_id, b.version + n - 1 AS base_version, CASE WHEN n = 1 THEN b.content_hash ELSE ph END AS base_hash,
  b.version + n AS predicted_version, po AS depends_on FROM q JOIN b USING (entity_id)
""")
def version_chain(spark, d):
    q = outbox.ordinals(T.queue(spark, d).where(F.col("state").isin("pending", "retrying")), "entity_id")
    base = versions.current(T.history(spark, d), deleted="include")
    return outbox.chain(q, base, "entity_id").select("operation_id", "entity_id", "base_version", "base_hash", "predicted_version", "depends_on")


@query(f"""
SELECT op_id AS operation_id, op_id % 11 + 2 AS attempts, 1000 + 1000000 * CAST(power(2, least(m - 1, 8)) AS BIGINT) AS due_at
FROM ({LOG}), (SELECT max(op_id % 11 + 1) AS m FROM ({LOG}) WHERE state = 'retrying') WHERE state = 'retrying'
""")
def retry_backoff(spark, d):
    return outbox.retry(T.queue(spark, d).where("state = 'retrying'"), 1000).select("operation_id", "attempts", "due_at")


@query(f"""
SELECT entity_id, CASE WHEN entity_id % 13 = 0 THEN 'authRequired' WHEN c > 4 THEN 'conflict' WHEN f > 12 THEN 'failed'
  WHEN entity_id % 7 = 0 THEN 'syncing' WHEN entity_id % 5 = 0 THEN 'offline' WHEN r > 15 THEN 'retrying' WHEN p > 5 THEN 'pending' ELSE 'synced' END AS status
FROM (SELECT entity_id, count(*) FILTER (state = 'conflict') AS c, count(*) FILTER (state = 'failed') AS f,
  count(*) FILTER (state = 'retrying') AS r, count(*) FILTER (state = 'pending') AS p FROM ({LOG}) GROUP BY 1)
""")
def status_precedence(spark, d):
    n = lambda s: F.count_if(F.col("state") == s)
    by = T.queue(spark, d).groupBy("entity_id").agg(*[n(s).alias(s) for s in ("conflict", "failed", "retrying", "pending")])
    e = F.col("entity_id")
    status = outbox.status(
        e % 13 != 0, e % 7 == 0, F.when(e % 5 == 0, "offline"),
        F.greatest(F.col("conflict") - 4, F.lit(0)), F.greatest(F.col("failed") - 12, F.lit(0)),
        F.greatest(F.col("retrying") - 15, F.lit(0)), F.greatest(F.col("pending") - 5, F.lit(0)),
    )
    return by.select("entity_id", status.alias("status"))


@query("""
SELECT coalesce(o_orderkey, l_orderkey) AS operation_id, CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem
FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) ON o_orderkey = l_orderkey
WHERE l_orderkey IS NULL OR o_orderkey IS NULL OR n > 1
""")
def response_bijection(spark, d):
    sent = T.read(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("operation_id"))
    got = T.read(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("operation_id"))
    return outbox.unmatched(sent, got)


@query("SELECT o_orderkey AS operation_id FROM orders JOIN (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE s <> o_orderstatus")
def replay_mismatch(spark, d):
    journal = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("operation_id"), F.lit("q").alias("request_hash"), F.col("o_orderstatus").alias("response"))
    again = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("operation_id")).agg(F.min("l_linestatus").alias("response"))
    return outbox.replay_mismatches(journal, again.withColumn("request_hash", F.lit("q")))


@query(f"SELECT state, count(*) AS n FROM (SELECT CASE state WHEN 'conflict' THEN 'retrying' ELSE state END AS state FROM ({LOG})) GROUP BY 1")
def startup_recovery(spark, d):
    q = T.queue(spark, d).withColumn("state", F.when(F.col("state") == "conflict", "in_flight").otherwise(F.col("state")))
    return outbox.recover(outbox.recover(q)).groupBy("state").agg(F.count("*").alias("n"))


# --- versions ----------------------------------------------------------------------------------


@query(f"SELECT entity_id, op_id, version, kind FROM ({HISTORY})")
def history_versions(spark, d):
    return T.history(spark, d).select("entity_id", "op_id", "version", "kind")


@query(f"SELECT entity_id, op_id, version FROM ({HISTORY}) WHERE changed_at <= TIMESTAMP '2024-01-05' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) = 1")
def as_of_moment(spark, d):
    moment = F.lit("2024-01-05").cast("timestamp_ntz")
    rows = T.history(spark, d).where(F.col("changed_at") <= moment)
    return versions.current(rows, deleted="include").select("entity_id", "op_id", "version")


@query(f"SELECT entity_id, op_id, kind FROM ({HISTORY}) WHERE version = 3")
def at_version(spark, d):
    return versions.at_version(T.history(spark, d), 3).select("entity_id", "op_id", "kind")


@query(f"SELECT entity_id, version, kind FROM (SELECT * FROM ({HISTORY}) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) = 1) WHERE kind <> 'delete'")
def tombstone_filter(spark, d):
    return versions.current(T.history(spark, d)).select("entity_id", "version", "kind")


@query(f"SELECT entity_id, version, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY entity_id ORDER BY version) AS p FROM ({HISTORY})) WHERE p = 'delete' AND kind NOT IN ('restore', 'delete')")
def silent_resurrection(spark, d):
    return versions.silent_resurrections(T.history(spark, d)).select("entity_id", "version", "kind")


@query(f"""
WITH h AS (SELECT * FROM ({HISTORY})), c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) = 1),
r AS (SELECT DISTINCT entity_id, 2 + entity_id % 90 AS to_version FROM h)
SELECT r.entity_id, r.to_version, CASE WHEN h.content_hash IS NULL THEN 'missing' WHEN h.content_hash = c.content_hash THEN 'unchanged' ELSE 'revert' END AS outcome,
  CASE WHEN h.content_hash <> c.content_hash THEN c.version + 1 END AS new_version
FROM r JOIN c USING (entity_id) LEFT JOIN h ON h.entity_id = r.entity_id AND h.version = r.to_version
""")
def revert_target(spark, d):
    h = T.history(spark, d)
    requests = h.select("entity_id", (F.col("entity_id") % 90 + 2).alias("to_version")).distinct()
    return versions.revert_targets(h, requests)


@query(f"""
WITH o AS (SELECT *, min(op_id) FILTER (kind = 'create') OVER (PARTITION BY entity_id) AS f FROM ({LOG})),
d AS (SELECT *, op_id > f IS TRUE AS lives, coalesce(arg_max(kind, op_id) FILTER (kind IN ('delete', 'restore') AND op_id > f) OVER b = 'delete', false) AS gone FROM o
      WINDOW b AS (PARTITION BY entity_id ORDER BY op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT *, op_id = f IS TRUE OR (lives AND kind = 'update' AND NOT gone) AS writes FROM d),
h AS (SELECT *, arg_max(content_hash, op_id) FILTER (writes) OVER (PARTITION BY entity_id ORDER BY op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old,
        arg_max(content_hash, op_id) FILTER (writes) OVER (PARTITION BY entity_id ORDER BY op_id) AS now FROM w),
r AS (SELECT *, CASE WHEN op_id = f THEN 'applied' WHEN kind = 'create' OR NOT lives THEN 'rejected' WHEN kind = 'delete' THEN CASE WHEN gone THEN 'unchanged' ELSE 'applied' END
        WHEN kind = 'restore' THEN CASE WHEN gone THEN 'applied' ELSE 'unchanged' END WHEN gone THEN 'rejected' WHEN content_hash = old THEN 'unchanged' ELSE 'applied' END AS outcome FROM h)
SELECT entity_id, op_id, outcome, count(*) FILTER (outcome = 'applied') OVER (PARTITION BY entity_id ORDER BY op_id) AS version, now AS content_hash,
  CASE WHEN lives AND kind IN ('delete', 'restore') THEN kind = 'delete' ELSE gone END AS deleted FROM r
""")
def lifecycle_fold(spark, d):
    ops = T.log(spark, d).withColumns({"base_version": F.lit(None).cast("long"), "base_hash": F.lit(None).cast("string"), "to_version": F.lit(None).cast("long")})
    return versions.fold(ops)


# --- changes -----------------------------------------------------------------------------------

CHANGES = f"SELECT op_id AS sequence, entity_id, 1 + op_id % 40 AS version, content_hash FROM ({LOG})"


def _changes(spark, d):
    return T.log(spark, d).select(F.col("op_id").alias("sequence"), "entity_id", (F.col("op_id") % 40 + 1).alias("version"), "content_hash")


@query(f"""
WITH c AS ({CHANGES}), b AS (SELECT *, max(version) OVER w AS seen FROM c WINDOW w AS (PARTITION BY entity_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT * FROM b WHERE seen IS NULL OR version > seen)
SELECT b.sequence, b.entity_id, CASE WHEN b.seen IS NULL OR b.version > b.seen THEN 'applied' WHEN b.version = b.seen AND b.content_hash <> a.content_hash THEN 'corrupt' ELSE 'ignored' END AS outcome
FROM b LEFT JOIN a ON a.entity_id = b.entity_id AND a.version = b.seen AND a.sequence < b.sequence
""")
def change_outcomes(spark, d):
    return changes.apply_changes(_changes(spark, d), "entity_id").select("sequence", "entity_id", "outcome")


@query(f"SELECT entity_id, sequence, version, content_hash FROM ({CHANGES}) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC, sequence) = 1")
def remote_latest_baseline(spark, d):
    return changes.baseline(_changes(spark, d), "entity_id").select("entity_id", "sequence", "version", "content_hash")


PAIRS = f"SELECT *, lag(kind) OVER w AS local_kind, lag(content_hash) OVER w AS local_hash, lag(props) OVER w AS local_props FROM ({HISTORY}) WINDOW w AS (PARTITION BY entity_id ORDER BY version)"


@query(f"""
SELECT entity_id, version, CASE WHEN local_hash = content_hash THEN NULL WHEN local_kind = 'create' AND kind = 'create' THEN 'concurrentCreate'
  WHEN 'delete' IN (local_kind, kind) THEN 'tombstoneDivergence' WHEN 'restore' IN (local_kind, kind) THEN 'restoreDivergence' ELSE 'divergentContent' END AS reason
FROM ({PAIRS}) WHERE local_kind IS NOT NULL
""")
def conflict_classification(spark, d):
    w = Window.partitionBy("entity_id").orderBy("version")
    h = T.history(spark, d).withColumns({"local_kind": F.lag("kind").over(w), "local_hash": F.lag("content_hash").over(w)})
    reason = changes.conflict_reason(F.col("local_kind"), F.col("kind"), F.col("local_hash"), F.col("content_hash"))
    return h.where("local_kind is not null").select("entity_id", "version", reason.alias("reason"))


@query(f"""
WITH p AS (SELECT entity_id, version, json_extract_string(props, '$.k') AS k, lag(json_extract_string(props, '$.k')) OVER w AS lk, lag(json_extract_string(props, '$.k'), 2) OVER w AS bk, kind
  FROM ({HISTORY}) WINDOW w AS (PARTITION BY entity_id ORDER BY version))
SELECT entity_id, version, 'k' AS field, CASE WHEN bk IS NOT DISTINCT FROM lk AND bk IS NOT DISTINCT FROM k THEN 'unchanged'
  WHEN bk IS NOT DISTINCT FROM k THEN 'localOnly' WHEN bk IS NOT DISTINCT FROM lk THEN 'cloudOnly' WHEN lk IS NOT DISTINCT FROM k THEN 'sameChange' ELSE 'diverged' END AS change
FROM p WHERE version > 2
UNION ALL SELECT entity_id, version, 'kind', 'cloudOnly' FROM p WHERE version > 2
""")
def field_diff(spark, d):
    w = Window.partitionBy("entity_id").orderBy("version")
    m = F.from_json("payload", "map<string,string>")
    h = T.history(spark, d).select("entity_id", "version", "kind", m.alias("own"), F.lag(m).over(w).alias("local"), F.lag(m, 2).over(w).alias("base"))
    h = h.where("version > 2").withColumn("cloud", F.map_concat("own", F.create_map(F.lit("kind"), F.col("kind"))))
    return changes.field_changes(h, "base", "local", "cloud").select("entity_id", "version", "field", "change")


@query(f"""
WITH b AS (SELECT entity_id, arg_max(content_hash, version) AS content_hash, 'a' || entity_id % 2 AS account_id FROM ({HISTORY}) WHERE version <= 5 GROUP BY 1),
p AS (SELECT entity_id, arg_max(content_hash, version) AS content_hash FROM ({HISTORY}) WHERE version > 5 GROUP BY 1)
SELECT entity_id, account_id, content_hash FROM b WHERE account_id <> 'a1'
UNION ALL SELECT entity_id, 'a1', content_hash FROM p WHERE entity_id % 2 = 1
""")
def snapshot_replace(spark, d):
    account = F.concat(F.lit("a"), (F.col("entity_id") % 2).cast("string"))
    h = T.history(spark, d).withColumns({"entity_type": F.lit("user"), "account_id": account, "page": F.floor(F.col("version") / 100), "ordinal": F.col("version")})
    old = h.where("version <= 5").groupBy("entity_type", "entity_id", "account_id").agg(F.max_by("content_hash", "version").alias("content_hash"))
    pages = h.where("version > 5")
    return changes.replace_snapshot(old, pages, "a1").select("entity_id", "account_id", "content_hash")


@query(f"""
WITH l AS (SELECT entity_id, arg_max(content_hash, (changed_at, op_id)) AS ph FROM ({LOG}) WHERE state <> 'settled' GROUP BY 1),
c AS (SELECT * FROM ({CHANGES}) QUALIFY version > coalesce(max(version) OVER (PARTITION BY entity_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
SELECT sequence, entity_id, CASE WHEN ph = content_hash THEN 'settle' ELSE 'conflict' END AS decision FROM c JOIN l USING (entity_id)
""")
def pending_conflicts(spark, d):
    applied = changes.apply_changes(_changes(spark, d), "entity_id")
    return changes.pending_conflicts(applied, T.queue(spark, d), "entity_id").select("sequence", "entity_id", "decision")


# --- papers ------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey AS paper_id, count(*) AS items, array_to_string(list_sort(list_filter([CASE WHEN min(l_linenumber) <> 1 THEN 'item order must start at 0' END,
  CASE WHEN max(l_linenumber) <> count(*) THEN 'item order must be contiguous' END, CASE WHEN count(DISTINCT l_linenumber) <> count(*) THEN 'item order must be unique' END],
  lambda x: x IS NOT NULL)), '; ') AS errors
FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)
""")
def paper_item_validation(spark, d):
    return papers.item_errors(T.items(spark, d)).withColumn("errors", F.array_join(F.array_sort("errors"), "; "))


TYPED = """
SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS item_order,
  p_type, l_quantity AS marks, p_name FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _typed(spark, d):
    li = T.read(spark, d, "lineitem").join(T.questions(spark, d), F.col("l_partkey") == F.col("id"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("paper_id"), F.row_number().over(w).cast("long").alias("item_order"), F.col("type").alias("question_type"),
        F.col("l_quantity").alias("marks"), "text", "difficulty", "subjects", "tags", F.col("l_extendedprice").alias("price"),
    )


@query(f"SELECT paper_id, item_order, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY p_type, item_order) - 1 AS INTEGER) AS place FROM ({TYPED})")
def categorized_order(spark, d):
    return papers.ordered(_typed(spark, d), categorized=True).select("paper_id", "item_order", "place")


@query(f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY p_type, item_order) - 1 AS place FROM ({TYPED}))
SELECT paper_id, item_order, CAST(place + 1 AS INTEGER) AS number, CAST(row_number() OVER (PARTITION BY paper_id, p_type ORDER BY place) AS INTEGER) AS section_number,
  row_number() OVER (PARTITION BY paper_id, p_type ORDER BY place) = 1 AS starts_section FROM p
""")
def section_numbering(spark, d):
    placed = papers.numbered(papers.ordered(_typed(spark, d), categorized=True))
    return placed.select("paper_id", "item_order", "number", "section_number", "starts_section")


@query("""
WITH c AS (SELECT * FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL') AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#21')),
a AS (SELECT p_type, count(*) AS n FROM c GROUP BY 1)
SELECT t AS type, r AS requested, coalesce(n, 0) AS available, r - coalesce(n, 0) AS short
FROM (VALUES ('single_choice', 'ECONOMY', 1), ('blank', 'PROMO', 1000000), ('short_answer', 'SMALL', 2000000)) v(t, k, r) LEFT JOIN a ON p_type = k WHERE coalesce(n, 0) < r
""")
def generation_feasibility(spark, d):
    request = generate.Request(1, 3_000_001, 0.5, (("single_choice", 1), ("blank", 1_000_000), ("short_answer", 2_000_000)), ("Brand#11", " brand#12", "BRAND#21"))
    quotas = spark.createDataFrame(list(request.quotas().items()), "type string, requested long")
    return generate.shortages(generate.candidates(T.questions(spark, d), request), quotas)


@query("""
SELECT n AS questions, CAST(c AS DOUBLE) AS coefficient, d AS difficulty, CASE d WHEN 'easy' THEN e WHEN 'medium' THEN m ELSE h END AS target
FROM (VALUES (10, 0.0, 10, 0, 0), (10, 0.25, 5, 5, 0), (7, 0.5, 0, 7, 0), (7, 0.75, 0, 4, 3), (5, 0.25, 3, 2, 0), (3, 1.0, 0, 0, 3), (0, 0.5, 0, 0, 0)) v(n, c, e, m, h), (VALUES ('easy'), ('medium'), ('hard')) k(d)
""")
def difficulty_targets(spark, d):
    rows = [
        (n, c, k, t)
        for n, c in ((10, 0.0), (10, 0.25), (7, 0.5), (7, 0.75), (5, 0.25), (3, 1.0), (0, 0.5))
        for k, t in generate.difficulty_targets(c, n).items()
    ]
    return spark.createDataFrame(rows, "questions int, coefficient double, difficulty string, target int")


@query(f"""
WITH i AS (SELECT paper_id, item_order, CASE WHEN paper_id % 3 = 0 THEN count(*) OVER (PARTITION BY paper_id) + paper_id % 5 ELSE 10 + paper_id % 90 END AS total,
  CASE WHEN item_order = 1 THEN 50.0 ELSE greatest(marks / 10, 0.01) END AS w FROM ({TYPED})),
s AS (SELECT *, greatest(total * w / sum(w) OVER p, 1.0) AS raw, count(*) OVER p AS n FROM i WINDOW p AS (PARTITION BY paper_id)),
f AS (SELECT *, CAST(floor(raw) AS BIGINT) AS whole, CAST(total - sum(floor(raw)) OVER (PARTITION BY paper_id) AS BIGINT) AS spare,
        row_number() OVER (PARTITION BY paper_id ORDER BY raw - floor(raw) DESC, item_order) - 1 AS k FROM s),
t AS (SELECT paper_id, item_order, spare, row_number() OVER (PARTITION BY paper_id ORDER BY turn, k) AS nth FROM (SELECT *, unnest(range(1, whole)) AS turn FROM f WHERE spare < 0)),
b AS (SELECT paper_id, item_order, count(*) AS taken FROM t WHERE nth <= -spare GROUP BY 1, 2)
SELECT paper_id, item_order, CAST(CASE WHEN total >= n THEN whole + CASE WHEN spare > 0 THEN spare // n + CASE WHEN k < spare % n THEN 1 ELSE 0 END ELSE -coalesce(taken, 0) END END AS BIGINT) AS marks
FROM f LEFT JOIN b USING (paper_id, item_order)
""")
def apportion_marks(spark, d):
    n = F.count("*").over(Window.partitionBy("paper_id"))
    total = F.when(F.col("paper_id") % 3 == 0, n + F.col("paper_id") % 5).otherwise(F.col("paper_id") % 90 + 10)
    weight = F.when(F.col("item_order") == 1, F.lit(50.0)).otherwise(F.col("marks") / 10)
    items = _typed(spark, d).select("paper_id", "item_order", total.alias("total"), weight.alias("w"))
    return generate.apportion(items, "paper_id", "item_order", "w", "total").select("paper_id", "item_order", "marks")


@query()
def generate_selection(spark, d):
    request = generate.Request(1, 20, 0.5, (("single_choice", 3), ("blank", 2), ("essay", 1)), ("Brand#11", "Brand#22"), (), ("blue",), 42, 30, 60)
    return generate.generate(T.questions(spark, d), [request])


@query(f"""
WITH i AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY p_type, item_order) - 1 AS place,
             row_number() OVER (PARTITION BY paper_id, p_type ORDER BY item_order) = 1 AS starts FROM ({TYPED})),
l AS (SELECT paper_id, count(*) AS n, string_agg(concat(
    CASE WHEN starts THEN CASE WHEN place > 0 THEN '\\end{{enumerate}}' || chr(10) ELSE '' END || '\\section*{{' || CASE p_type WHEN 'ECONOMY' THEN 'Single Choice'
      WHEN 'LARGE' THEN 'Multiple Choice' WHEN 'MEDIUM' THEN 'True or False' WHEN 'PROMO' THEN 'Fill in the Blank' WHEN 'SMALL' THEN 'Short Answer' ELSE 'Essay' END
      || '}}' || chr(10) || '\\begin{{enumerate}}' || chr(10) ELSE '' END,
    '\\item ', replace(p_name, ' ', ' \\& '), ' \\hfill \\textit{{[', CAST(CAST(marks AS BIGINT) AS VARCHAR), ' marks]}}',
    CASE WHEN p_type = 'ECONOMY' THEN chr(10) || '\\begin{{enumerate}}[label=\\Alph*.,itemsep=0.2em]' || chr(10) || '\\item ' || replace(p_name, ' ', '\\_' || chr(10) || '\\item ')
      || '\\_' || chr(10) || '\\end{{enumerate}}' ELSE '' END,
    CASE WHEN p_type = 'STANDARD' THEN chr(10) || '\\vspace{{3.30cm}}' ELSE '' END), chr(10) ORDER BY place) AS body FROM i GROUP BY paper_id)
SELECT o_orderkey AS paper_id, 'Paper #' || o_orderkey || '.tex' AS filename, concat('\\documentclass[UTF8,12pt]{{ctexart}}', chr(10),
  '\\usepackage[a4paper,margin=2cm]{{geometry}}', chr(10), '\\usepackage{{amsmath,amssymb}}', chr(10), '\\usepackage{{enumitem}}', chr(10), '\\usepackage{{graphicx}}', chr(10),
  '\\usepackage{{xcolor}}', chr(10), '\\setlength{{\\parindent}}{{0pt}}', chr(10), '\\setlist[enumerate]{{leftmargin=*,itemsep=',
  CASE WHEN n >= 24 THEN '0.15em' WHEN n >= 14 THEN '0.35em' ELSE '0.8em' END, '}}', chr(10), '\\begin{{document}}', chr(10), '\\begin{{center}}', chr(10),
  '{{\\LARGE\\bfseries Paper \\#', o_orderkey, '}}\\\\[0.6em]', chr(10), o_orderpriority, ' \\quad Duration: 90 minutes \\quad Total Marks: ',
  CAST(round(o_totalprice) AS BIGINT), chr(10), '\\end{{center}}', chr(10), '\\vspace{{0.8em}}', chr(10),
  CASE WHEN n IS NOT NULL THEN body || chr(10) || '\\end{{enumerate}}' || chr(10) ELSE '' END, '\\end{{document}}', chr(10)) AS content
FROM orders LEFT JOIN l ON paper_id = o_orderkey
""")
def export_tex(spark, d):
    items = papers.numbered(papers.ordered(_typed(spark, d), categorized=True)).withColumns(
        {
            "text": F.replace("text", F.lit(" "), F.lit(" & ")),
            "options": F.when(F.col("question_type") == "single_choice", F.transform("tags", lambda t: F.concat(t, F.lit("_")))),
            "answer": F.col("difficulty"),
            "essay_lines": F.lit(6),
        }
    )
    o = T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.concat(F.lit("Paper #"), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("subject"), F.lit(90).alias("duration_minutes"), F.round("o_totalprice").cast("long").alias("total_marks"),
    )
    return export.tex(o, items)


@query("""
SELECT l_orderkey AS paper_id, count(*) AS items, round(sum(l_quantity), 2) AS total_marks FROM lineitem GROUP BY 1
""")
def paper_totals(spark, d):
    return papers.totals(T.items(spark, d)).withColumn("total_marks", F.round("total_marks", 2))


@query("""
SELECT conv_id, turn, (SELECT max(p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role <> c.role) AS parent,
  (SELECT count(*) FROM conversations p JOIN conversations n ON n.conv_id = p.conv_id AND n.turn = p.turn + 1 WHERE p.conv_id = c.conv_id AND n.turn <= c.turn AND n.role <> p.role) AS depth
FROM conversations c
""")
def comment_threads(spark, d):
    """A turn answers the nearest earlier one of another role; its depth is how often the role has changed before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = T.read(spark, d, "conversations").select("conv_id", "turn", "role")
    changed = c.withColumn("new", F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(False)).cast("int")).withColumn("depth", F.sum("new").over(w))
    last = changed.groupBy("conv_id", "depth").agg(F.max("turn").alias("parent")).withColumn("depth", F.col("depth") + 1)
    return changed.join(last, ["conv_id", "depth"], "left").select("conv_id", "turn", "parent", "depth")

"""The contract queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, images, jaccard, merkle, packing, quality, resample, rules, sharding, substring, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left", "n_cut_lines")
    return judged.select("doc_id", *names)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


#: The contract's rules (fixed values).
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op9_trust_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    return done.select(
        F.col("record_id").alias("page_id"),
        "canonical_url",
        F.col("resolved_id").alias("resolved_page_id"),
        "outcome",
        F.col("headers")["cache-control"].alias("cache_control"),
        F.col("headers")["content-length"].alias("content_length"),
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["last-modified"].alias("last_modified"),
        F.col("headers")["x-cache"].alias("x_cache"),
    )


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited crops of the tile images of every vector whose id is divisible by 50, against all vectors' images: a row each."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = images.edited(images.tiles(vectors.where("vec_id % 50 = 0")))
    return images.best_copies(asked, images.tiles(vectors))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what verification says where a third of the texts have been lower-cased."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    low = F.translate("text", resample.UPPER, resample.LOWER)
    changed = merkle.leaf(*[low if c == "text" else F.col(c) for c in merkle.COLUMNS])
    made = merkle.manifest(table(spark, sf_dir, "documents"), also={"changed": F.when(tampered, changed)})
    made = made.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
        merkle.folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.judged(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op10_image_copies": op10_image_copies,
    "op3_revisit_resolution": op3_revisit_resolution,
    "op1_bradley_terry": op1_bradley_terry,
    "op9_trust_propagation": op9_trust_propagation,
    "op2_substring_dedup": op2_substring_dedup,
    "op4_line_frequency_rules": op4_line_frequency_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op8_best_two_fit": op8_best_two_fit,
    "op6_byte_shards": op6_byte_shards,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_extendible_dedup": op12_extendible_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

#: crc32 by half bytes: its table of sixteen entries (fixed values), then an expression of the text {x}.
_CRC_TABLE = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
    "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
)


def _crc32(x: str) -> str:
    nibbles = f"list_transform(range(2 * octet_length(encode({x}))), lambda k: strpos('0123456789ABCDEF', substr(hex(encode({x})), k + 2 - 2 * (k % 2), 1)) - 1)"
    step = f"lambda c, v: xor(c >> 4, ({_CRC_TABLE})[(xor(c, v) & 15) + 1])"
    return f"xor(list_reduce({nibbles}, {step}, 4294967295::BIGINT), 4294967295)"


#: DuckDB reads these; see the tests for the queries that have none.
ORACLE_SQL: dict[str, str] = {
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM t)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM t
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM t LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = t.doc_id GROUP BY 1, 2
""",
    "op2_substring_dedup": r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t
), g AS (
  SELECT doc_id, i, w[i] AS word,
         CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i : i + 19], ' ') END AS win FROM p
), r AS (
  SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM g
), c AS (
  SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
""",
    "op4_line_frequency_rules": r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, CASE WHEN i + 2 <= len(w) THEN count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 2], ' '), i + 2 <= len(w)) > 1
                    ELSE false END AS again
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)
), r AS (
  SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM (
    SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM g)
  GROUP BY doc_id
), l AS (
  SELECT doc_id, source, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, unnest(lines) AS line FROM t)
), hosts AS (
  SELECT source, least(greatest(5.0, count(*) * 0.1), greatest(50.0, count(*) * 0.01), 1000.0) AS most FROM t GROUP BY source
), common AS (
  SELECT l.source, line FROM l JOIN hosts ON l.source IS NOT DISTINCT FROM hosts.source
  GROUP BY l.source, line, most HAVING count(DISTINCT doc_id) > most
), cut AS (
  SELECT doc_id, sum(len(string_split(l.line, ' '))) AS n_cut, count(*) AS n_cut_lines
  FROM l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_cut, 0) AS n_cut, coalesce(n_cut_lines, 0) AS n_cut_lines
  FROM t LEFT JOIN r USING (doc_id) LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_cut >= 0.2 * n_words AS kept,
       CAST(n_words - n_cut AS BIGINT) AS n_left, n_cut_lines
FROM m
""",
    "op3_revisit_resolution": r"""
WITH parts AS (
  SELECT page_id, coalesce(html, '') AS html, url LIKE '%://%' AS ok,
         regexp_extract(url, '^[^:/?#]+://([^#]*)', 1) AS whole
  FROM pages
), keyed AS (
  SELECT page_id, html,
         CASE WHEN ok THEN
           regexp_replace(regexp_replace(lower(regexp_extract(whole, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
           || regexp_replace(regexp_extract(whole, '^[^/?]*([^?]*)', 1), '/+$', '')
           || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
                string_split(regexp_extract(whole, '^[^?]*\?(.*)$', 1), '&'),
                lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&'), ''), '')
         END AS canonical_url
  FROM parts
), as_of AS (
  SELECT v.page_id, v.canonical_url, r.page_id AS found, r.html,
         CASE v.page_id % 4 WHEN 1 THEN NULL WHEN 3 THEN 'changed' ELSE md5(v.html) END AS v_tag, CASE WHEN v.page_id % 2 = 0 THEN 'm' || v.page_id % 7 END AS v_date,
         CASE WHEN r.page_id % 5 <> 0 THEN md5(r.html) END AS r_tag, CASE WHEN r.page_id % 3 <> 0 THEN 'm' || r.page_id % 7 END AS r_date
  FROM keyed v LEFT JOIN keyed r
    ON r.canonical_url = v.canonical_url
   AND (r.page_id < v.page_id + 500)
  QUALIFY row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) = 1
), judged AS (
  SELECT *, CASE WHEN found IS NULL THEN 'orphan' WHEN v_tag = r_tag THEN 'etag' WHEN v_tag <> r_tag THEN 'mismatch'
                 WHEN v_date = r_date THEN 'last-modified' WHEN v_date <> r_date THEN 'mismatch' ELSE 'unvalidated' END AS outcome
  FROM as_of
)
SELECT page_id, canonical_url, outcome,
       CASE WHEN good THEN found END AS resolved_page_id,
       CASE WHEN good THEN 'max-age=600' END AS cache_control,
       CASE WHEN good THEN CAST(octet_length(encode(html)) AS VARCHAR) END AS content_length,
       CASE WHEN good THEN coalesce(CASE page_id % 4 WHEN 0 THEN 'W/' ELSE '' END || '"' || v_tag || '"', '"' || r_tag || '"') END AS etag,
       CASE WHEN good THEN coalesce(v_date, r_date) END AS last_modified,
       CASE WHEN good THEN 'hit' END AS x_cache
FROM (SELECT *, outcome IN ('etag', 'last-modified') AS good FROM judged)
""",
    "op12_extendible_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
""",
    "op13_importance_resampling": rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), '{resample.UPPER}', '{resample.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT unnest(list_filter(string_split_regex(
    translate(coalesce(text, ''), '{resample.UPPER}', '{resample.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word
  FROM benchmark
), f AS (
  SELECT doc_id, unnest(w) AS word FROM d
), names AS (
  SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM f UNION SELECT word FROM b)
), s AS (
  SELECT bucket, count(*) AS s FROM f JOIN names USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN names USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM s) + 10000.0::DOUBLE)
                               / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN names USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= n * 10 // 100 THEN nth END AS rank FROM ranked
""",
    "op11_merkle_manifest": rf"""
WITH RECURSIVE src AS (
  SELECT doc_id, lang, {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS tampered,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
         text, translate(text, '{resample.UPPER}', '{resample.LOWER}') AS low
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS changed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM src
), nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8, n
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 8, n
), sides AS (
  SELECT a.lang, a.level, a.i, string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i) AS before, string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i) AS after
  FROM nodes a JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.i // 8 = b.i // 8
  WHERE a.n > 1 GROUP BY a.lang, a.level, a.i
), top_sides AS (
  SELECT a.level, a.i, string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i) AS before, string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i) AS after
  FROM tops a JOIN tops b ON a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.level, a.i
), up AS (
  SELECT doc_id, lang, 0 AS level, i, coalesce(changed, leaf) AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT u.doc_id, u.lang, u.level + 1, u.i // 8, sha256(coalesce(s.before, '') || u.folded || coalesce(s.after, '')), u.proof || coalesce(s.before, '') || coalesce(s.after, '')
  FROM up u JOIN sides s ON u.lang IS NOT DISTINCT FROM s.lang AND u.level = s.level AND u.i = s.i
), ends AS (
  SELECT u.doc_id, s.subroot, s.i, u.folded, u.proof
  FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1) u JOIN subroots s ON u.lang IS NOT DISTINCT FROM s.lang
), over_ AS (
  SELECT doc_id, 0 AS level, i, folded, proof FROM ends
  UNION ALL
  SELECT u.doc_id, u.level + 1, u.i // 8, sha256(coalesce(s.before, '') || u.folded || coalesce(s.after, '')), u.proof || coalesce(s.before, '') || coalesce(s.after, '')
  FROM over_ u JOIN top_sides s ON u.level = s.level AND u.i = s.i
), done AS (
  SELECT * FROM over_ QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1
)
SELECT doc_id, leaf, subroot, root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = root AS verified
FROM leaves JOIN done d USING (doc_id) JOIN ends USING (doc_id), (SELECT digest AS root FROM tops WHERE n = 1)
""",
}

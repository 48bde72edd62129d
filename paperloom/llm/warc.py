"""WARC revisits: a not-modified capture takes its content from the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cluster

#: Headers that a not-modified answer may replace in the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """A key for one resource: host lower-cased without www. and default ports, no scheme, fragment, tracking
    parameters or closing slash, parameters sorted; null for null and for urls without ``://``."""
    whole = F.regexp_extract(url, r"(?s)^[^:/?#]+://([^#]*)", 1)
    host = F.lower(F.regexp_extract(whole, r"(?s)^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(whole, r"(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(whole, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(host, path, query))


def _weak(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, canonical_url, resolved_id, outcome, headers) for each revisit record.

    records has record_id long, warc_type string, target_uri string, captured
    (any ordered type), status int and headers map<string, string> with
    lower-case names; more columns are not read.  A full response is a record
    of type response and status 200.  "Earlier" is by captured, then record_id;
    records without captured or canonical url neither serve nor are served.

    outcome is ``etag`` or ``last-modified`` by the validator that agreed
    (entity tags compare weakly and come first), ``mismatch`` where the first
    validator that both have differs, ``unvalidated`` where they share none,
    ``orphan`` without an earlier response.  Where a validator agreed,
    resolved_id is the response and headers its headers, with those of
    ``PERMITTED`` from the revisit; elsewhere both are null.  A repeated
    revisit row gives a repeated result.

    Plan: records are ranged by (url, time), so one url may span partitions;
    each partition's last response of its edge urls is carried to the next.
    """
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = records.where("warc_type in ('response', 'revisit')").select(
        canonical_url(F.col("target_uri")).alias("url"), "captured", "record_id", "warc_type", "status", "headers"
    )
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    usable = F.col("url").isNotNull() & F.col("captured").isNotNull()
    ranged = cluster.checkpoint(
        rows.where(usable & (full | (F.col("warc_type") == "revisit")))
        .withColumn("found", F.when(full, F.struct("captured", "record_id", "headers")))
        .select("url", "captured", "record_id", "warc_type", "headers", "found")
        .repartitionByRange(parts, "url", "captured", "record_id")
        .withColumn("part", F.spark_partition_id())
    )
    # Urls on partition edges are at most two for each partition.
    edges = ranged.groupBy("part").agg(F.min("url").alias("lo"), F.max("url").alias("hi"))
    edge_urls = edges.select(F.col("lo").alias("url")).union(edges.select("hi")).groupBy("url").count().where("count > 1")
    tails = (
        ranged.join(F.broadcast(edge_urls.select("url")), "url")
        .where("found is not null")
        .groupBy("part", "url")
        .agg(F.max(F.struct("captured", "record_id")).alias("last"))
    )
    heads = edges.select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("url"))
    earlier = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        heads.join(tails, ["part", "url"], "left")
        .withColumn("carry", F.last("last", ignorenulls=True).over(earlier))
        .where("carry is not null")
        .select("part", "url", F.col("carry.record_id").alias("c_id"), F.col("carry.captured").alias("c_time"))
    )
    stored = ranged.where("found is not null").select("url", "found").join(F.broadcast(edge_urls.select("url")), "url")
    carried = (
        stored.join(F.broadcast(carried), "url")
        .where("found.record_id = c_id and found.captured = c_time")
        .groupBy("part", "url")
        .agg(F.first("found").alias("carry"))
    )
    own = Window.partitionBy("part", "url").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    as_of = (
        ranged.withColumn("near", F.last("found", ignorenulls=True).over(own))
        .where("warc_type = 'revisit'")
        .join(F.broadcast(carried), ["part", "url"], "left")
        .withColumn("found", F.coalesce("near", "carry"))
        .select("record_id", F.col("url").alias("canonical_url"), "headers", "found")
    )
    lost = rows.where((F.col("warc_type") == "revisit") & ~usable).select(
        "record_id", F.col("url").alias("canonical_url"), "headers"
    )
    as_of = as_of.unionByName(lost, allowMissingColumns=True)
    mine, theirs = F.col("headers"), F.col("found.headers")
    tag, their_tag = _weak(mine["etag"]), _weak(theirs["etag"])
    since, their_since = mine["last-modified"], theirs["last-modified"]
    outcome = (
        F.when(F.col("found").isNull(), "orphan")
        .when(tag == their_tag, "etag")
        .when(tag.isNotNull() & their_tag.isNotNull(), "mismatch")
        .when(since == their_since, "last-modified")
        .when(since.isNotNull() & their_since.isNotNull(), "mismatch")
        .otherwise("unvalidated")
    )
    permitted = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, _: ~F.map_contains_key(permitted, k))
    merged = F.map_concat(kept, permitted)
    good = F.col("outcome").isin("etag", "last-modified")
    return as_of.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        F.when(good, F.col("found.record_id")).alias("resolved_id"),
        "outcome",
        F.when(good, merged).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history of a table (page_id, url, html): a response and a later revisit of each page.

    A page is captured at its id and visited again 500 later, so pages of one
    canonical url come between.  Validators depend on the id: responses lack
    an entity tag or a date at times, revisits have a weak, strong, changed or
    no tag and at times a date; both have a header that may not be replaced.
    Null html is empty; repeated pages are repeated captures.
    """
    i, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    date = F.concat(F.lit("m"), (i % 7).cast("string"))
    new_tag = F.when(i % 4 == 0, F.concat(F.lit("W/"), tag)).when(i % 4 == 2, tag).when(i % 4 == 3, F.lit('"changed"'))

    def headers(**named) -> Column:
        pairs = F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("k"), v.alias("v")) for k, v in named.items()])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))

    response = headers(
        content_type=F.lit("text/html"), content_length=F.octet_length(html).cast("string"), cache_control=F.lit("max-age=60"), x_cache=F.lit("hit"),
        etag=F.when(i % 5 != 0, tag), last_modified=F.when(i % 3 != 0, date),
    )
    revisit = headers(
        content_length=F.lit("0"), cache_control=F.lit("max-age=600"), x_cache=F.lit("miss"), etag=new_tag, last_modified=F.when(i % 2 == 0, date)
    )
    capture = lambda kind, at, status, h: F.struct(F.lit(kind).alias("warc_type"), at.alias("captured"), F.lit(status).alias("status"), h.alias("headers"))
    kinds = F.array(capture("response", i, 200, response), capture("revisit", i + 500, 304, revisit))
    return pages.select("page_id", "url", F.explode(kinds).alias("r")).select(i.alias("record_id"), F.col("url").alias("target_uri"), "r.*")

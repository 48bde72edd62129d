"""Counts, blob integrity, foreign keys, retention and completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import content_hash


def live_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, live) for each table; rows with a deleted_at are not live."""
    parts = []
    for name, df in tables.items():
        live = df.where("deleted_at is null") if "deleted_at" in df.columns else df
        parts.append(live.agg(F.count("*").alias("live")).select(F.lit(name).alias("entity"), "live"))
    return reduce(DataFrame.union, parts)


def blobs(files: DataFrame) -> DataFrame:
    """One row for each stored content: (blob_hash, byte_size, uses)."""
    return files.groupBy("blob_hash", "byte_size").agg(F.count("*").alias("uses"))


def blob_conflicts(files: DataFrame, *described_by: str) -> DataFrame:
    """Hashes that are described in more than one way."""
    return (
        files.groupBy("blob_hash")
        .agg(F.countDistinct(F.struct(*described_by)).alias("descriptions"))
        .where("descriptions > 1")
    )


def missing_references(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key is set and not in the parent."""
    return child.where(F.col(key).isNotNull()).join(parent, F.col(key) == F.col(parent_key), "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def retention(backups: DataFrame, workspace: str, cutoff_micros: int) -> DataFrame:
    """Automatic, verified backups of the workspace older than the cutoff."""
    return backups.where(
        F.col("automatic") & F.col("verified") & (F.col("workspace_id") == workspace) & (F.col("created_at") < cutoff_micros)
    )


def next_due(settings: DataFrame, interval_micros: int) -> DataFrame:
    """next_due: the later of the last attempt and success, and the interval; enabled settings only."""
    last = F.greatest("last_attempt", "last_success")
    return settings.where("enabled").withColumn("next_due", F.coalesce(last + interval_micros, F.lit(0)))


def manifest_errors(files: DataFrame) -> DataFrame:
    """(path, error) for paths that repeat, and roles of which there must be exactly one."""
    twice = repeated(files, "path").select("path", F.lit("repeated path").alias("error"))
    roles = files.groupBy().agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("database", "metadata")])
    wrong = roles.select(
        F.explode(
            F.array(*[F.when(F.col(r) != 1, F.lit(f"exactly one {r} file is required")) for r in ("database", "metadata")])
        ).alias("error")
    ).where("error is not null")
    return twice.unionByName(wrong.select(F.lit(None).cast("string").alias("path"), "error"))


def payload_differences(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): missing, unexpected, or of another size or hash."""
    m, f = manifest.alias("m"), found.alias("f")
    joined = m.join(f, F.col("m.path") == F.col("f.path"), "full_outer")
    problem = (
        F.when(F.col("f.path").isNull(), "missing")
        .when(F.col("m.path").isNull(), "unexpected")
        .when((F.col("m.size") != F.col("f.size")) | (F.col("m.sha256") != F.col("f.sha256")), "changed")
    )
    return joined.select(F.coalesce("m.path", "f.path").alias("path"), problem.alias("problem")).where("problem is not null")


def missing_chunks(uploads: DataFrame, received: DataFrame) -> DataFrame:
    """(upload_id, chunks, received, missing) from (upload_id, chunks) and (upload_id, chunk)."""
    got = received.groupBy("upload_id").agg(F.array_sort(F.collect_set("chunk")).alias("got"))
    joined = uploads.join(got, "upload_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<int>")))
    every = F.when(F.col("chunks") > 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array().cast("array<int>"))
    return joined.select("upload_id", "chunks", F.size("got").alias("received"), F.array_except(every, "got").alias("missing"))


def sorted_strictly(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key is not above the one before, within equal order groups."""
    w = Window.partitionBy(order).orderBy(key)
    return rows.withColumn("previous", F.lag(key).over(w)).where(F.col("previous") >= F.col(key))


def attachments_of(links: DataFrame, attachments: DataFrame, deleted: bool = False) -> DataFrame:
    """Attachments with their owners by the link table, live ones only unless ``deleted``."""
    own = attachments if deleted else attachments.where("deleted_at is null")
    return links.join(own, "attachment_id")


def automatic_backups(files: DataFrame, prefix: str, *endings: str) -> DataFrame:
    """Files that the scheduler made, by their names."""
    name = F.col("name")
    ends = F.lit(False)
    for e in endings:
        ends = ends | name.endswith(e)
    return files.where(name.startswith(prefix) & ends)


def newest(files: DataFrame, *key: str) -> DataFrame:
    """The most recently modified file of each key; the later name of equals."""
    rest = [c for c in files.columns if c not in key]
    return files.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("modified", "name")).alias("_r")).select(*key, "_r.*")


def payload_totals(files: DataFrame, max_file: int, max_total: int, *key: str) -> DataFrame:
    """(key, files, total, error): bytes of each archive as a decimal that cannot overflow, and which cap they break."""
    size = F.col("size").cast("decimal(20,0)")
    out = files.groupBy(*key).agg(F.count("*").alias("files"), F.sum(size).alias("total"), F.max("size").alias("_most"))
    error = F.when(F.col("_most") > max_file, "file too large").when(F.col("total") > max_total, "payload too large")
    return out.withColumn("error", error).drop("_most")


def folder_sizes(files: DataFrame) -> DataFrame:
    """(folder, files, bytes) of every folder above a file (path with slashes, size), the root as an empty name.

    Sizes are summed by a file's own folder before they go to the folders
    above, so a folder with very many files sends one row a task to each.  A
    total is a decimal that cannot overflow.
    """
    parts = F.split(F.ltrim(F.col("path"), F.lit("/")), "/+")
    own = files.select(F.slice(parts, 1, F.size(parts) - 1).alias("_at"), F.col("size").cast("decimal(20,0)").alias("size"))
    own = own.groupBy("_at").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    above = F.transform(F.sequence(F.lit(0), F.size("_at")), lambda n: F.array_join(F.slice("_at", 1, n), "/"))
    return own.select(F.explode(above).alias("folder"), "files", "bytes").groupBy("folder").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def unsupported_entries(entries: DataFrame) -> DataFrame:
    """(path, error) of entries (path, kind) that a tree to be moved may not hold: links, and what is neither file nor folder."""
    error = F.when(F.col("kind") == "link", "symbolic link").when(~F.coalesce(F.col("kind").isin("file", "folder"), F.lit(False)), "unsupported file type")
    return entries.select("path", error.alias("error")).where("error is not null")


TARGETS = ("question", "paper", "draft", "comment")


def link_errors(links: DataFrame, attachments: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (target_type, target_id, attachment_id) with the rule that they break, in order; null for none.

    attachments: attachment_id, target_type, target_id, owner_id, scope,
    deleted_at; targets: target_type, target_id, owner_id, scope, deleted_at.
    An attachment is linked to the live target that it names, of its own owner
    and scope, and to targets of one type only.
    """
    a = attachments.select("attachment_id", *[F.col(c).alias(f"_a_{c}") for c in ("target_type", "target_id", "owner_id", "scope", "deleted_at")], F.lit(True).alias("_a"))
    t = targets.select("target_type", "target_id", *[F.col(c).alias(f"_t_{c}") for c in ("owner_id", "scope", "deleted_at")], F.lit(True).alias("_t"))
    kinds = links.groupBy("attachment_id").agg(F.count_distinct("target_type").alias("_kinds"))
    no = lambda same: ~F.coalesce(same, F.lit(False))
    error = (
        F.when(F.col("_a").isNull(), "no attachment")
        .when(no((F.col("_a_target_type") == F.col("target_type")) & (F.col("_a_target_id") == F.col("target_id"))), "another target")
        .when(F.col("_t").isNull(), "no target")
        .when(F.col("_a_deleted_at").isNotNull() | F.col("_t_deleted_at").isNotNull(), "deleted")
        .when(no(F.col("_a_owner_id") == F.col("_t_owner_id")), "another owner")
        .when(no(F.col("_a_scope") == F.col("_t_scope")), "another scope")
        .when(F.col("_kinds") > 1, "linked elsewhere")
    )
    joined = links.join(a, "attachment_id", "left").join(t, ["target_type", "target_id"], "left").join(kinds, "attachment_id")
    return joined.withColumn("error", error).select(*links.columns, "error")


#: What an attachment's content hash covers, by its JSON names (fixed values).
ATTACHMENT = {
    "targetType": "target_type", "targetId": "target_id", "fileName": "file_name", "mediaType": "media_type",
    "byteSize": "byte_size", "blobHash": "blob_hash", "caption": "caption", "position": "position",
}


def attachment_hash() -> Column:
    """The content hash of an attachment's row; its id, owner, scope, version and times are left out."""
    return content_hash("attachment", 1, F.struct(*[F.col(c).alias(n) for n, c in ATTACHMENT.items()]))


def device_states(devices: DataFrame, runtime: DataFrame) -> DataFrame:
    """Registered devices with their runtime state, by account and device."""
    return devices.join(runtime, ["account_id", "device_id"])

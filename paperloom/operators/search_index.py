"""A stored inverted index that follows its bank: segments of postings, tombstones, and statistics kept with each version."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.segments import SEGMENT, Segments
from ..sources.shared import checkpoint
from .search import index, index_hits, score_hits, search

#: Changed rows, as a share of all, and segments, from which a compaction pays.
STALE_SHARE, MAX_SEGMENTS = 0.2, 16


class StoredIndex:
    """Postings (token, id, field, size, places) and rows (id, size, live), by segments of one store.

    A change of a row writes its new postings and a row of ``rows`` in a new
    segment; what older segments say of that id is dead from then on, and is
    left out when it is read.  The facts of a version are docs, the number of
    live rows (those without tokens too), and tokens, their sizes' total, so a
    search reads the postings of its phrase and the ids that changed since the
    first segment, nothing else.
    """

    def __init__(self, spark: SparkSession, path: str, fields: Mapping[str, Column], id_col: str = "id", id_type: str = "long"):
        self.store = Segments(spark, path)
        self.fields, self.id_col = fields, id_col
        self.postings_schema = f"token string, id {id_type}, field int, size int, places array<int>"
        self.rows_schema = f"id {id_type}, size int, live boolean"

    def _taken(self, bank: DataFrame) -> tuple[dict, DataFrame]:
        """The segment of a bank's postings, and (id, size, live) of its rows as that segment has them: texts are read once.

        Rows are dealt by id, as the files of a bank may be one part each.  A
        file is runs sorted by token, each of many rows, so postings are
        neither shuffled nor sorted through.
        """
        made = index(bank.repartition(self.id_col), self.id_col, self.fields).where("token is not null")
        postings = self.store.write(made.select("token", "id", "field", "size", "places"))
        sizes = self.store.written(postings, self.postings_schema).select("id", "size")
        blank = bank.select(F.col(self.id_col).alias("id"), F.lit(0).alias("size"))  # rows without tokens have no postings
        return postings, sizes.union(blank).groupBy("id").agg(F.max("size").alias("size")).withColumn("live", F.lit(True))

    def build(self, bank: DataFrame) -> dict:
        """The index of a bank, in place of what there was."""
        postings, rows = self._taken(bank)
        rows = self.store.write(self._by_id(rows))
        facts = dict(zip(("docs", "tokens"), self._sums(self.store.written(rows, self.rows_schema)), strict=True))
        return self.store.commit(self.store.manifest(), replace={"postings": postings, "rows": rows}, facts=facts)

    def _by_id(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", F.col("size").cast("int").alias("size"), "live").sortWithinPartitions("id")

    @staticmethod
    def _sums(rows: DataFrame) -> tuple[int, int]:
        """Live rows and their tokens."""
        return tuple(rows.where("live").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first())

    def rows(self, manifest: dict | None = None) -> DataFrame:
        """(id, size, live): the last word on each id, tombstones too."""
        all_ = self.store.read("rows", self.rows_schema, manifest)
        return all_.groupBy("id").agg(F.max_by(F.struct("size", "live"), SEGMENT).alias("_r")).select("id", "_r.*")

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Take in inserted and changed rows (one an id) and deleted ids, as one version; compacts where that pays.

        Deleting what is not there, or again, changes nothing; an id in both is
        deleted.  A batch that was taken in before is not taken in again.
        """
        base = self.store.manifest()
        if batch and base["batches"].get(batch[0], -1) >= batch[1]:
            return base
        none = self.store.empty(self.rows_schema)
        gone = none.select("id") if deletes is None else deletes.select(F.col(self.id_col).alias("id")).distinct()
        postings, rows = self.store.empty(self.postings_schema), none
        if upserts is not None:
            postings, rows = self._taken(upserts.join(gone, upserts[self.id_col] == gone["id"], "left_anti"))
        added = self.store.write(self._by_id(rows.unionByName(gone.select("id", F.lit(0).alias("size"), F.lit(False).alias("live")))))
        change = self.store.written(added, self.rows_schema)
        old = self.rows(base).join(change.select("id"), "id", "left_semi")
        plus, minus = self._sums(change), self._sums(old)
        facts = {k: base["facts"].get(k, 0) + p - m for k, p, m in zip(("docs", "tokens"), plus, minus, strict=True)}
        new = self.store.commit(base, add={"postings": postings, "rows": added}, facts=facts, batch=batch)
        segments = new["tables"]["rows"]
        stale = sum(s["rows"] for s in segments[1:])
        if len(segments) > MAX_SEGMENTS or stale > STALE_SHARE * max(1, segments[0]["rows"]):
            new = self.compact()
        return new

    def compact(self) -> dict:
        """One segment with what is live; old versions stay readable."""
        base = self.store.manifest()
        live = self._alive(self.store.read("postings", self.postings_schema, base), base).drop(SEGMENT)
        live = live.sortWithinPartitions("token", "id")  # each file by itself: a search reads some pages of each
        return self.store.commit(base, replace={"postings": live, "rows": self._by_id(self.rows(base).where("live"))})

    def _alive(self, postings: DataFrame, manifest: dict) -> DataFrame:
        """Postings of whose id no later segment speaks."""
        later = self.store.read("rows", self.rows_schema, manifest, first=1)
        later = later.groupBy(F.col("id").alias("_id")).agg(F.max(SEGMENT).alias("_last"))
        return postings.join(later, F.col("id") == F.col("_id"), "left").where(F.col("_last").isNull() | (F.col("_last") == F.col(SEGMENT))).drop("_id", "_last")

    def hits(self, phrase: str, version: int | None = None) -> DataFrame:
        """(id, size, hits) of live rows that hold the phrase, from the row groups of its tokens."""
        manifest = self.store.manifest(version)
        return index_hits(self.store.read("postings", self.postings_schema, manifest), phrase, lambda found: self._alive(found, manifest))

    def search(
        self,
        bank: DataFrame,
        phrase: str = "",
        values: Mapping[str, Sequence[str]] | None = None,
        relations: Mapping[str, Sequence[str]] | None = None,
        deleted: str = "exclude",
        version: int | None = None,
    ) -> DataFrame:
        """Rows of the bank that pass all filters of ``search.search``; a phrase is looked up, not scanned for."""
        rows = search(bank, "", (), values, relations, deleted)
        if not phrase.strip():
            return rows
        return rows.join(self.hits(phrase, version).select(F.col("id").alias("_hit")), rows[self.id_col] == F.col("_hit"), "left_semi")

    def ranked(self, bank: DataFrame, phrase: str, version: int | None = None) -> DataFrame:
        """Rows of the bank that hold the phrase, with the score that a scan of all live rows gives."""
        facts = self.store.manifest(version)["facts"]
        hits = checkpoint(self.hits(phrase, version))  # their number and their rows, of one reading
        docs = facts.get("docs", 0)
        stats = hits.agg(F.count("*").alias("held")).select(F.lit(docs).alias("docs"), F.lit(facts.get("tokens", 0) / docs if docs else None).cast("double").alias("mean_size"), "held")
        scored = score_hits(hits, stats)
        return bank.join(scored, bank[self.id_col] == scored["id"]).select(*[bank[c] for c in bank.columns], "score")

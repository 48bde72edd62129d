"""Plans and partitions whose size must not grow with the input."""

from __future__ import annotations

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from paperloom.operators import dependencies, papers, search, versions
from paperloom.operators.search_index import StoredIndex


def test_numbering_sorts_by_place_once(spark):
    items = spark.createDataFrame(
        [(1, 0, "blank"), (1, 1, "essay"), (1, 2, "single_choice"), (1, 3, "blank"), (2, 0, "essay"), (2, 1, None), (2, 2, None)], "paper_id long, item_order int, question_type string"
    )
    placed = papers.ordered(items, True)
    found = papers.numbered(placed)
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2  # by type and item order, and by place
    got = {(r.paper_id, r.item_order): (r.number, r.section_number, r.starts_section) for r in found.where("paper_id = 1").collect()}
    assert got == {(1, 2): (1, 1, True), (1, 0): (2, 1, True), (1, 3): (3, 2, False), (1, 1): (4, 1, True)}


def test_a_range_of_the_fold_is_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(versions, "RANGE_BITS", 4)
    path, part = str(tmp_path / "sizes"), versions._part

    def counted(key, ops: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        with open(path, "a") as f:
            f.write(f"{len(ops)}\n")
        return part(key, ops, given)

    ops = spark.range(300).select(
        F.col("id").alias("op_id"), (F.col("id") % 2).alias("entity_id"), F.when(F.col("id") < 2, "create").when(F.col("id") % 7 == 0, "revert").otherwise("update").alias("kind"),
        F.lit(None).cast("long").alias("base_version"), F.lit(None).cast("string").alias("base_hash"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"), (F.col("id") % 5 + 1).alias("to_version"),
    )
    want = sorted(versions._based_fold(ops).collect())
    monkeypatch.setattr(versions, "_part", counted)
    got = sorted(versions._based_fold(ops).collect())
    monkeypatch.setattr(versions, "RANGE_BITS", 17)
    assert got == want == sorted(versions._based_fold(ops).collect()) and len(got) == 300
    assert max(int(x) for x in open(path).read().split()[:20]) <= 16


def test_postings_are_made_without_a_shuffle(spark):
    bank = spark.createDataFrame([(1, "b a b", "s"), (2, None, "s t"), (3, "", None)], "id long, text string, source string")
    found = search.index(bank, "id", search.document_fields(subjects=None, tags=None))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.id, r.field, r.token, r.size, r.places) for r in found.collect()), key=str)
    assert got == [(1, 0, "a", 4, [1]), (1, 0, "b", 4, [0, 2]), (1, 1, "s", 4, [0]), (2, 1, "s", 2, [0]), (2, 1, "t", 2, [1]), (3, 0, None, 0, [])]


def test_runs_of_entries_are_bounded_and_sorted(spark, monkeypatch):
    texts = [(i, None if i % 7 == 0 else " ".join(f"w{(i * k) % 5}" for k in range(i % 9)), "s" if i % 2 else None) for i in range(50)]
    bank = spark.createDataFrame(texts, "id long, text string, source string").coalesce(1)
    monkeypatch.setattr(search, "RUN_BYTES", 200, raising=False)
    monkeypatch.setattr(search, "OUT_ROWS", 3, raising=False)
    want = []
    for i, *fields in texts:
        words = [(f or "").split() for f in fields]
        size = sum(map(len, words))
        want += [(i, k, t, size, [p for p, x in enumerate(w) if x == t]) for k, w in enumerate(words) for t in set(w)] or [(i, 0, None, 0, [])]
    rows = search.index(bank, "id", search.document_fields(subjects=None, tags=None)).collect()
    assert sorted(((r.id, r.field, r.token, r.size, r.places) for r in rows), key=str) == sorted(want, key=str)
    falls = sum((a.token or "~") > (b.token or "~") for a, b in zip(rows, rows[1:], strict=False))
    assert 2 < falls < 20  # a run has several rows, and there are several runs


def test_a_stored_index_reads_texts_once(spark, tmp_path):
    """One reading for postings, sizes and totals, of a build and of a change."""
    path = str(tmp_path / "read")

    @F.udf("string")
    def text(i):
        with open(path, "a") as f:
            f.write("x")
        return f"of the {i}" if i % 5 else ""

    bank = spark.range(40).withColumn("text", text("id"))
    stored = StoredIndex(spark, str(tmp_path / "index"), {"text": F.col("text")})
    stored.build(bank.where("id < 30"))
    assert len(open(path).read()) == 30 and stored.store.manifest()["facts"] == {"docs": 30, "tokens": 72}
    stored.apply(bank.where("id >= 27"), bank.where("id < 3"))
    assert len(open(path).read()) == 43 and stored.store.manifest()["facts"] == {"docs": 37, "tokens": 90}
    assert {r.id for r in stored.hits("of the").collect()} == {i for i in range(3, 40) if i % 5}


def test_a_compacted_index_is_read_without_a_join(spark, tmp_path):
    """No segment after the first: nothing is looked up, and no Python worker makes the empty table."""
    stored = StoredIndex(spark, str(tmp_path / "index"), {"text": F.col("text")})
    stored.build(spark.range(9).withColumn("text", F.lit("of the")))
    plan = lambda: stored.hits("of")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan() and "ExistingRDD" not in plan()
    stored.apply(None, spark.range(2, 3))  # deletes alone, too few to compact
    assert "Join" in plan() and "ExistingRDD" not in plan() and stored.hits("of").count() == 8
    assert stored.store.manifest()["facts"] == {"docs": 8, "tokens": 16} and stored.compact()["tables"]["rows"][0]["rows"] == 8
    assert "Join" not in plan() and stored.hits("of").count() == 8


def test_levels_write_edges_only_while_both_ends_are_there(spark, monkeypatch, tmp_path):
    """Each operation waits for its half: what nothing waits for is half of those left, so all rounds together write few times the edges."""
    cut, n = [], 512
    whole = dependencies.checkpoint

    def counted(rows):
        made = whole(rows)
        cut.append(made.count())
        return made

    monkeypatch.setattr(dependencies, "checkpoint", counted)
    monkeypatch.setattr(dependencies, "passing_folder", lambda spark: str(tmp_path), raising=False)
    ids = spark.range(1, n).withColumnRenamed("id", "operation_id")
    edges = ids.where("operation_id > 1").withColumn("depends_on", F.expr("operation_id div 2"))
    got = {r.operation_id: (r.level, r.problem) for r in dependencies.levels(ids, edges).collect()}
    assert got == {i: (i.bit_length() - 1, None) for i in range(1, n)}
    written = sum(pq.read_metadata(f).num_rows for f in tmp_path.rglob("*.parquet"))
    assert sum(cut) + written < 6 * n

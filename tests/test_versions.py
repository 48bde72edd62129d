from __future__ import annotations

from paperloom.operators import changes, outbox, papers, versions

OPS = "entity_id long, op_id long, kind string, base_version long, base_hash string, content_hash string, to_version long"


def test_fold(spark):
    rows = [
        (1, 1, "update", None, None, "a", None),
        (1, 2, "create", None, None, "a", None),
        (1, 3, "create", None, None, "z", None),
        (1, 4, "update", 1, "a", "a", None),
        (1, 5, "update", 1, "a", "b", None),
        (1, 6, "update", 1, "a", "c", None),
        (1, 7, "delete", 2, "b", None, None),
        (1, 8, "delete", None, None, None, None),
        (1, 9, "update", None, None, "d", None),
        (1, 10, "restore", 3, "b", None, None),
        (1, 11, "revert", 4, "b", None, 1),
        (1, 12, "revert", None, None, None, 99),
        (2, 1, "create", None, None, "q", None),
    ]
    got = versions.fold(spark.createDataFrame(rows, OPS)).orderBy("entity_id", "op_id").collect()
    assert [(r.outcome, r.version, r.content_hash, r.deleted) for r in got] == [
        ("rejected", 0, None, False),
        ("applied", 1, "a", False),
        ("rejected", 1, "a", False),
        ("unchanged", 1, "a", False),
        ("applied", 2, "b", False),
        ("stale", 2, "b", False),
        ("applied", 3, "b", True),
        ("unchanged", 3, "b", True),
        ("rejected", 3, "b", True),
        ("applied", 4, "b", False),
        ("applied", 5, "a", False),
        ("rejected", 5, "a", False),
        ("applied", 1, "q", False),
    ]


def test_apply_is_idempotent(spark):
    rows = [(1, 7, 1, "a"), (2, 7, 1, "a"), (3, 7, 1, "x"), (4, 7, 3, "c"), (5, 7, 2, "b"), (6, 8, 1, "q")]
    log = spark.createDataFrame(rows, "sequence long, entity_id long, version long, content_hash string")
    got = changes.apply_changes(log, "entity_id").orderBy("sequence").collect()
    assert [r.outcome for r in got] == ["applied", "ignored", "corrupt", "applied", "ignored", "applied"]
    assert {(r.entity_id, r.version) for r in changes.baseline(log, "entity_id").collect()} == {(7, 3), (8, 1)}


def test_bijection_and_settlement(spark):
    sent = spark.createDataFrame([(1, "in_flight"), (2, "in_flight"), (3, "in_flight")], "operation_id int, state string")
    got = spark.createDataFrame([(1, "accepted"), (2, "conflict"), (2, "conflict"), (9, "accepted")], "operation_id int, status string")
    assert {(r.operation_id, r.problem) for r in outbox.unmatched(sent, got).collect()} == {(2, "repeated"), (3, "missing"), (9, "unexpected")}
    done = outbox.settle(sent, got.distinct()).collect()
    assert {(r.operation_id, r.state) for r in done} == {(1, "settled"), (2, "conflict"), (3, "in_flight")}


def test_reorder_needs_a_permutation(spark):
    items = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "paper_id int, item_id string, item_order int")
    orders = spark.createDataFrame([(1, ["b", "a"]), (2, ["c", "c"])], "paper_id int, item_ids array<string>")
    got = {(r.item_id, r.item_order) for r in papers.reorder(items, orders).collect()}
    assert got == {("a", 1), ("b", 0), ("c", 0)}

"""The exchange with a service: pages, batches, lost answers, failures between any two steps, and a rebuild."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import settle
from paperloom.sources.cursor import Page
from paperloom.streaming import worker


def payload_hash(payload):
    text = "null" if payload is None else json.dumps(json.loads(payload), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


class Service:
    """A service with versions and an idempotent push; it can lose its answer, fail, or forget old changes."""

    def __init__(self):
        self.state, self.log, self.answered, self.acked, self.applied = {}, [], {}, None, []
        self.lose_answer = self.fail_push = self.fail_pull = self.expired = False
        self.page = 3

    def write(self, entity, payload, kind="update"):
        version = self.state.get(entity, (0,))[0] + 1
        self.state[entity] = version, payload_hash(payload), payload
        self.log.append((f"s{len(self.log)}", "question", entity, "delete" if payload is None else kind, version, payload_hash(payload), payload, len(self.log)))
        return self.state[entity]

    def pull(self, cursor, limit):
        if self.fail_pull:
            raise worker.TransportFailed("OFFLINE")
        if self.expired:
            raise worker.CursorExpired
        n = int(cursor or 0)
        new = self.log[n : n + min(limit, self.page)]
        return Page(new, str(n + len(new)), n + len(new) < len(self.log))

    def snapshot(self, cursor, limit):
        n, all_ = int(cursor or 0), sorted(self.state.items())
        part = [(f"z{e}", "question", e, "delete" if p is None else "update", v, h, p, 0) for e, (v, h, p) in all_[n : n + 2]]
        return Page(part, str(n + 2), n + 2 < len(all_), "snap"), str(len(self.log))

    def acknowledge(self, cursor):
        self.acked = cursor

    def push(self, operations):
        if self.fail_push:
            raise worker.TransportFailed("BUSY")
        out = []
        for o in operations:
            if o.operation_id not in self.answered:
                version, own, _ = self.state.get(o.entity_id, (None, None, None))
                if (o.base_version, o.base_hash) == (version, own):
                    version, own, _ = self.write(o.entity_id, o.payload, o.kind)
                    self.applied.append(o.operation_id)
                    self.answered[o.operation_id] = (o.operation_id, "applied", version, own, None, json.dumps({"changeCursor": f"s{len(self.log) - 1}"}))
                else:
                    self.answered[o.operation_id] = (o.operation_id, "conflict", version or 1, own or "0" * 64, f"c-{o.operation_id}", "{}")
            out.append(self.answered[o.operation_id])
        if self.lose_answer:
            raise worker.TransportFailed("LOST")
        return out


def operation(i, entity, payload, owner=None):
    return (f"o{i:03}", "question", entity, "update", payload, "pending", i, owner)


def enqueue(spark, kept, *operations):
    kept.enqueue(spark.createDataFrame(list(operations), "operation_id string, entity_type string, entity_id string, kind string, payload string, state string, created_at long, owner_id string"))


def states(kept):
    return {r.operation_id: r.state for r in kept.table("queue").collect()}


def test_a_batch_survives_a_lost_answer(spark, tmp_path):
    kept, service = settle.Exchanged(spark, str(tmp_path / "x")), Service()
    service.write("e1", '{"v": 0}')
    enqueue(spark, kept, operation(1, "e1", '{"v": 1}'), operation(2, "e1", '{"v": 2}'), operation(3, "e2", None), operation(4, "e1", "{}", "other"))
    service.lose_answer = True
    # The remote change of e1 differs from this account's latest operation on it, so that one is a conflict before anything is sent.
    report = worker.run_once(kept, service, "me", 10, "b1")
    assert report.deferred == "LOST"
    assert states(kept) == {"o001": "retrying", "o002": "conflict", "o003": "retrying", "o004": "pending"}
    sent = {r.operation_id: (r.base_version, r.depends_on) for r in kept.table("queue").collect()}
    assert sent["o001"] == (1, []) and sent["o003"] == (None, [])
    service.lose_answer = False
    enqueue(spark, kept, operation(5, "e9", "{}"), operation(6, "e9", "[]"))
    assert worker.run_once(kept, service, "me", 11, "b2").pushed == 2  # the first batch is not due, a new one goes
    chained = {r.operation_id: (r.base_version, r.depends_on) for r in kept.table("queue").collect()}
    assert chained["o006"] == (1, ["o005"])
    report = worker.run_once(kept, service, "me", 5_000_000, "b3")
    assert report.pushed == 1  # the pull before has brought back what o003 did, and settled it
    assert sorted(service.applied) == ["o001", "o003", "o005", "o006"]
    assert states(kept) == {"o001": "settled", "o002": "conflict", "o003": "settled", "o004": "pending", "o005": "settled", "o006": "settled"}
    worker.run_once(kept, service, "me", 9_000_000, "b4")
    base = {r.entity_id: (r.version, r.content_hash) for r in kept.table("baseline").collect()}
    assert base == {e: (v, h) for e, (v, h, _) in service.state.items()}
    assert kept.store.manifest()["facts"]["acknowledged_cursor"] == service.acked == str(len(service.log))


def test_a_page_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    kept, service = settle.Exchanged(spark, str(tmp_path / "x")), Service()
    for k in range(4):
        service.write(f"e{k % 2}", json.dumps({"v": k}))
    with monkeypatch.context() as m:
        m.setattr(settle.Exchanged, "acknowledge", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            worker.run_once(kept, service, "me", 1, "b")
    first = sorted(map(tuple, kept.table("baseline").collect()))
    assert len(first) == 2 and "acknowledged_cursor" not in kept.store.manifest()["facts"]
    service.page = 100
    worker.run_once(kept, service, "me", 2, "b")  # the page comes again with one more change
    assert {r.entity_id: r.version for r in kept.table("baseline").collect()} == {"e0": 2, "e1": 2}
    before = kept.store.manifest()["version"]
    bad = spark.createDataFrame([("s9", "question", "e0", "update", 2, "f" * 64, "{}", 0, 1)], worker.WITH_ORDER)
    with pytest.raises(settle.CorruptChange):
        kept.receive(bad, "9", 3)
    assert kept.store.manifest()["version"] == before


def test_conflicts_name_their_bases(spark, tmp_path):
    kept = settle.Exchanged(spark, str(tmp_path / "x"))
    page = lambda *rows: spark.createDataFrame([(*r, k) for k, r in enumerate(rows, 1)], worker.WITH_ORDER)
    change = lambda v, p, kind="update": (f"s{v}", "question", "e", kind, v, payload_hash(p), p, v)
    kept.receive(page(change(1, '{"v": 1}')), "1", 1)
    op = ("o1", "question", "e", "update", 1, payload_hash('{"v": 1}'), '{"v": "mine"}', [], None, "pending", None, 0, 1, None, 0, None, None)
    kept.enqueue(spark.createDataFrame([op], settle.QUEUE))
    kept.receive(page(change(2, '{"v": 2}'), change(3, None, "delete"), change(4, '{"v": "mine"}')), "4", 2)
    got = {r.cloud_version: (r.reason, r.base_snapshot, r.cloud_snapshot, r.hydration_state) for r in kept.table("conflicts").collect()}
    assert got == {2: ("divergentContent", '{"v":1}', '{"v":2}', "complete"), 3: ("tombstoneDivergence", None, "null", "complete")}
    row = kept.table("queue").first()
    assert (row.state, row.error_code) == ("settled", None)  # the last change brought what the operation wanted
    assert kept.table("baseline").first().version == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_random_runs_agree_in_the_end(spark, tmp_path, seed):
    rng = random.Random(seed)
    kept, service, now = settle.Exchanged(spark, str(tmp_path / "x")), Service(), 1
    made = 0
    for step in range(5):
        for _ in range(rng.randint(0, 2)):
            service.write(f"e{rng.randrange(3)}", rng.choice([None, json.dumps({"v": rng.randrange(3)})]))
        some = [operation(made + k, f"e{rng.randrange(4)}", rng.choice([None, json.dumps({"v": rng.randrange(3)})])) for k in range(rng.randint(1, 3))]
        made += len(some)
        enqueue(spark, kept, *some)
        service.lose_answer, service.fail_push, service.fail_pull = (rng.random() < 0.3 for _ in range(3))
        worker.run_once(kept, service, "me", now, f"b{step}")
        now += rng.choice([1, 400_000_000])
    service.lose_answer = service.fail_push = service.fail_pull = False
    for k in range(3):
        now += 400_000_000
        worker.run_once(kept, service, "me", now, f"end{k}")
    base = {r.entity_id: (r.version, r.content_hash) for r in kept.table("baseline").collect()}
    assert base == {e: (v, h) for e, (v, h, _) in service.state.items()}
    assert set(states(kept).values()) <= {"settled", "conflict"} and len(states(kept)) == made
    assert len(service.applied) == len(set(service.applied))
    journal = {r.operation_id for r in kept.table("journal").collect()}
    assert journal <= set(service.answered) and set(service.applied) <= {k for k, v in states(kept).items()}


def test_an_expired_cursor_rebuilds(spark, tmp_path):
    kept, service = settle.Exchanged(spark, str(tmp_path / "x")), Service()
    service.write("gone", "{}")
    worker.run_once(kept, service, "me", 1, "b0")
    for k in range(5):
        service.write(f"e{k}", json.dumps({"v": k}))
    del service.state["gone"]
    enqueue(spark, kept, operation(1, "e1", '{"v": 1}'), operation(2, "e2", '{"v": "own"}'))
    service.expired = True
    report = worker.run_once(kept, service, "me", 2, "b1")
    assert report.rebuilt and service.acked == str(len(service.log))
    assert {r.entity_id for r in kept.table("baseline").collect()} == {f"e{k}" for k in range(5)}
    assert states(kept) == {"o001": "settled", "o002": "conflict"}
    assert [(r.operation_id, r.cloud_version) for r in kept.table("conflicts").where(F.col("hydration_state") == "complete").collect()] == [("o002", 1)]

from __future__ import annotations

from paperloom.operators import changes
from paperloom.streaming.baseline import baseline_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 5, 1 + (i * 7) % 11, f"h{i % 3}") for i in range(60)]
    schema = "sequence long, entity_id long, version long, content_hash string"
    log = spark.createDataFrame(rows, schema)
    for k in range(3):
        log.where(f"sequence div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = baseline_stream(source).writeStream.format("memory").queryName("base").outputMode("update")
    q = out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("base").collect():
        if r.entity_id not in last or r.applied + r.ignored + r.corrupt > sum(last[r.entity_id][2:]):
            last[r.entity_id] = (r.version, r.content_hash, r.applied, r.ignored, r.corrupt)
    batch = {r.entity_id: r.version for r in changes.baseline(log, "entity_id").collect()}
    assert {k: v[0] for k, v in last.items()} == batch
    applied = changes.apply_changes(log, "entity_id").where("outcome = 'applied'").count()
    assert sum(v[2] for v in last.values()) == applied


def test_pull_cycle_equals_batch(spark, tmp_path):
    """Three pages, one of them twice, in two runs: the baseline and the cursor are those of all changes at once."""
    import random

    from paperloom.operators import changes
    from paperloom.streaming import cycle

    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    rng = random.Random(3)
    rows = [(s, "question", f"e{rng.randrange(30)}", rng.randint(1, 9), rng.choice("ab") * 64) for s in range(300)]
    pages, state = str(tmp_path / "pages"), str(tmp_path / "state")
    for k, part in enumerate((rows[:100], rows[100:200], rows[:100], rows[200:])):
        spark.createDataFrame(part, cycle.CHANGE).coalesce(1).write.mode("append").parquet(pages)
        if k == 1:
            assert cycle.acknowledged(spark, state) is None
            cycle.follow(spark, pages, state, str(tmp_path / "log")).awaitTermination(120)
            assert cycle.acknowledged(spark, state) <= 199
    cycle.follow(spark, pages, state, str(tmp_path / "log")).awaitTermination(120)
    want = changes.baseline(spark.createDataFrame(rows, cycle.CHANGE))
    names = ["entity_type", "entity_id", "sequence", "version", "content_hash"]
    assert sorted(map(tuple, cycle.stored(spark, state).select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def brute_exchange(events):
    base, waiting, out = {}, {}, []
    for e, at, side, op, kind, v, bv, bh, h in events:
        own = waiting.setdefault(e, [])
        if side == "local":
            own.append((op, h, bv, bh))
        else:
            outcome = decision = operation = reason = known = None
            b = base.get(e)
            if b and (b[0] > v or b == (v, h)):
                outcome = "ignored"
            elif b and b[0] == v:
                outcome = "corrupt"
            else:
                outcome = "applied"
                if own:
                    operation = own[-1][0]
                    if own[-1][1] == h:
                        decision = "settle"
                        own.pop()
                    else:
                        decision, reason, known = "conflict", "tombstoneDivergence" if kind == "delete" else "divergentContent", bool(b) and b == own[-1][2:]
                base[e] = (v, h)
            out.append((e, at, outcome, decision, operation, reason, known))
    return out


def test_exchange_stream(spark, tmp_path):
    """Shuffled micro-batches, a restart and a snapshot at the start give what one pass in order gives."""
    import random

    from paperloom.streaming import exchange

    rng = random.Random(8)
    all_ = []
    for at in range(1, 200):
        side = rng.choice(["local", "remote", "remote"])
        local = (f"o{at}", rng.randint(1, 9), rng.choice("ab")) if side == "local" else (None, None, None)
        all_.append((f"e{rng.randrange(6)}", at, side, local[0], rng.choice(["update", "delete"]), None if side == "local" else 1 + at // 3 + rng.randint(-8, 2), *local[1:], rng.choice("ab")))
    cut = 40
    names = [f.split()[0] for f in exchange.INPUT.split(", ")]

    def frame(events):
        return spark.createDataFrame([("question", *r) for r in events], exchange.INPUT).select(names)

    first = brute_exchange(all_[:cut])
    assert sorted(map(repr, first)) == sorted(repr(tuple(r)[1:]) for r in exchange.received(frame(all_[:cut])).collect())
    # The state after the first part, as tables.
    base, waiting = {}, {}
    for e, _, _, _, _, v, _, _, h in [r for r in all_[:cut] if r[2] == "remote"]:
        if e not in base or v > base[e][0]:
            base[e] = (v, h)
    settled = {r[4] for r in first if r[3] == "settle"}
    waiting = [(e, at, op, bv, bh, h) for e, at, side, op, _, _, bv, bh, h in all_[:cut] if side == "local"]
    baselines = spark.createDataFrame([("question", e, v, h) for e, (v, h) in base.items()], "entity_type string, entity_id string, version long, content_hash string")
    queue = spark.createDataFrame(
        [("question", e, op, at, "settled" if op in settled else "pending", h, bv, bh) for e, at, op, bv, bh, h in waiting],
        "entity_type string, entity_id string, operation_id string, created_at long, state string, payload_hash string, base_version long, base_hash string",
    )
    start = exchange.snapshot(baselines, queue)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(cut, 199, 40):
            part = all_[k : k + 40]
            rng.shuffle(part)
            frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
            source = spark.readStream.schema(frame(part).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
            made = exchange.received(source, start).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            made.option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = brute_exchange(all_)[len(first) :]
    got = [tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r[3] for r in want} == {None, "settle", "conflict"}


class Pages:
    """A service of seven pages, for the cursor source; what was acknowledged is a file."""

    def __init__(self, options):
        self.folder, self.stop = options["folder"], int(options.get("available", 7))
        self.snapshots = options.get("snapshots", "same")

    def pull(self, cursor, limit):
        from paperloom.sources.cursor import Page

        n = 0 if cursor is None else int(cursor.removeprefix("c-"))
        if n >= self.stop:
            return Page([], f"c-{n}", False, "s")
        changes = [(n * 100 + k, "question", f"e{k % 9}", n * 100 + k + 1, "a" * 64) for k in range(min(limit, 100))]
        return Page(changes, f"c-{n + 1}", n + 1 < self.stop, "s" if self.snapshots == "same" else f"s{n}")

    def acknowledge(self, cursor):
        from pathlib import Path

        Path(self.folder, cursor).touch()


def test_cursor_source(spark, tmp_path):
    """Stopped and started again at each page, the feed loses and repeats nothing, and the cursor is acknowledged after its page."""
    from paperloom.sources import cursor
    from paperloom.streaming import cycle

    spark.dataSource.register(cursor.ChangeFeed)
    got, state, log = [], str(tmp_path / "state"), str(tmp_path / "log")
    acknowledged = tmp_path / "ack"
    acknowledged.mkdir()

    def feed(**options):
        return spark.readStream.format("change_feed").options(transport="tests.test_streaming:Pages", folder=str(acknowledged), **options).load()

    for available in (1, 2, 3, 5, 7):
        q = cycle.follow(spark, feed(available=available), state, log, on_page=lambda page: got.append(sorted(r.sequence for r in page.collect())))
        q.awaitTermination(120)
    seen = [s for page in got for s in page]
    assert seen == sorted(set(seen)) and cycle.acknowledged(spark, state) == max(seen)
    assert seen == list(range(len(seen))) and len(seen) >= 500 and all(len(p) <= 100 for p in got)


def test_cursor_reader_limits():
    import pytest

    from paperloom.sources import cursor

    reader = cursor._Reader(Pages({"folder": "/tmp"}), 3)
    at = reader.initialOffset()
    for _ in range(3):
        _, at = reader.read(at)
    with pytest.raises(cursor.PageLimitExceeded):
        reader.read(at)
    other = cursor._Reader(Pages({"folder": "/tmp", "snapshots": "new"}), 9)
    _, at = other.read(other.initialOffset())
    with pytest.raises(cursor.SnapshotChanged):
        other.read(at)
    last = cursor._Reader(Pages({"folder": "/tmp", "available": 1}), 9)
    _, at = last.read(last.initialOffset())
    assert list(last.read(at)[0]) == [] and last.read(at)[1] == at
    assert len(list(last.readBetweenOffsets(last.initialOffset(), at))) == 100

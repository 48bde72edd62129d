"""Stored tables: commits, crashes, replays, the index that follows its bank, the pull cycle, settlement and blobs."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.operators import dependencies, export, inventory, search, settle, versions
from paperloom.operators.search_index import StoredIndex
from paperloom.sources.blobs import BlobStore, CorruptBlob, digests
from paperloom.sources.segments import CommitConflict, Segments
from paperloom.streaming import cycle


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_commits(spark, tmp_path):
    store = Segments(spark, str(tmp_path / "t"))
    make = lambda *x: spark.createDataFrame([(v,) for v in x], "v long")
    first = store.commit(store.manifest(), add={"a": make(1, 2)}, facts={"n": lambda written: written["a"]}, batch=("s", 4))
    assert first["facts"] == {"n": 2} and store.commit(first, add={"a": make(9)}, batch=("s", 4)) == first
    second = store.commit(first, add={"a": make(3), "b": make(7)})
    with pytest.raises(CommitConflict):
        store.commit(first, add={"a": make(4)})
    read = lambda m: sorted(r.v for r in store.read("a", "v long", m).collect())
    assert read(store.manifest(1)) == [1, 2] and read(None) == [1, 2, 3]
    third = store.commit(second, fold={"a": (1, make(5))}, replace={"b": make()})
    assert read(third) == [1, 2, 5] and store.read("b", "v long").count() == 0
    gone = store.vacuum()
    assert len(gone) == 3 and read(None) == [1, 2, 5]  # what the loser wrote, and two replaced segments
    with pytest.raises(ValueError, match="no version"):
        store.manifest(1)


def test_a_crash_between_data_and_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    page = lambda *x: spark.createDataFrame([(s, "question", f"e{s % 3}", s + 1, "a" * 64) for s in x], cycle.CHANGE)
    cycle.merge(page(0, 1, 2), path, ("feed", 0))
    before = rows(cycle.stored(spark, path))
    with monkeypatch.context() as m:
        m.setattr(Segments, "_publish", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            cycle.merge(page(3, 4, 5), path, ("feed", 1))
    assert rows(cycle.stored(spark, path)) == before and cycle.acknowledged(spark, path) == 2
    outcomes = cycle.merge(page(3, 4, 5), path, ("feed", 1))
    again = cycle.merge(page(3, 4, 5), path, ("feed", 1))
    assert {r.outcome for r in outcomes.collect()} == {"applied"} and {r.outcome for r in again.collect()} == {"ignored"}
    assert cycle.acknowledged(spark, path) == 5 and rows(cycle.stored(spark, path, 1)) == before


def test_the_baseline_folds_its_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cycle, "MAX_SEGMENTS", 3)
    rng, path, all_ = random.Random(5), str(tmp_path / "state"), []
    for number in range(8):
        page = [(number * 10 + k, "question", f"e{rng.randrange(12)}", rng.randint(1, 9), rng.choice("ab") * 64) for k in range(10)]
        all_ += page
        cycle.merge(spark.createDataFrame(page, cycle.CHANGE), path, ("feed", number))
    assert len(Segments(spark, path).manifest()["tables"]["baseline"]) <= 4
    best = {}
    for s, _, e, v, h in all_:
        if e not in best or v > best[e][1]:
            best[e] = (s, v, h)
    assert {r.entity_id: (r.sequence, r.version, r.content_hash) for r in cycle.stored(spark, path).collect()} == best


# --- the stored index --------------------------------------------------------------------------


def bank_of(spark, texts):
    return spark.createDataFrame([(i, t, "src", ["t a"]) for i, t in texts.items()], "id long, text string, source string, tags array<string>")


def test_index_follows_its_bank(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: rng.choice(["red", "blue", "Of", "the", "é"])
    text = lambda: rng.choice([None, "", " ".join(word() for _ in range(rng.randint(1, 12)))])
    texts = {i: text() for i in range(60)}
    fields = {"text": F.coalesce("text", F.lit(""))}
    stored = StoredIndex(spark, str(tmp_path / "index"), fields)
    stored.build(bank_of(spark, texts))
    first = dict(texts)
    for number in range(4):
        up = {i: text() for i in rng.sample(range(90), 9)}
        down = rng.sample(range(100), 6)
        stored.apply(bank_of(spark, up), spark.createDataFrame([(i,) for i in down], "id long"), ("edits", number))
        stored.apply(bank_of(spark, {1000: "of the"}), None, ("edits", number))  # a batch that was taken in
        texts = {i: t for i, t in (texts | up).items() if i not in down}
        bank = bank_of(spark, texts)
        got = {r.id: round(r.score, 9) for r in stored.ranked(bank, "of the").collect()}
        assert got == {r.id: round(r.score, 9) for r in search.ranked(bank, "id", fields, "of the").collect()} and got
        facts = stored.store.manifest()["facts"]
        assert facts["docs"] == len(texts) == stored.rows().where("live").count()
    bank = bank_of(spark, first)
    assert {r.id for r in stored.hits("of the", 1).collect()} == {r.id for r in search.ranked(bank, "id", fields, "of the").collect()}
    stored.compact()
    assert len(stored.store.manifest()["tables"]["rows"]) == 1
    bank = bank_of(spark, texts)
    assert {r.id for r in stored.ranked(bank, "of the").collect()} == set(got)
    assert stored.hits("").collect() == [] and stored.hits("nowhere").collect() == []
    for phrase, relations in (("of the", {"tags": ["t a"]}), ("of the", {"tags": ["no"]}), ("", {}), (" ", {})):
        want = search.search(bank, phrase, ["text"], {"source": ["src", "x"]}, relations)
        assert rows(stored.search(bank, phrase, {"source": ["src", "x"]}, relations).select("id")) == rows(want.select("id"))


def test_a_rare_phrase_reads_few_rows(spark, tmp_path):
    """The token reaches the Parquet reader as a filter, and pages without it are not read."""
    stored = StoredIndex(spark, str(tmp_path / "index"), {"text": F.col("text")})
    bank = spark.range(150_000).select("id", F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" common")).alias("text"))
    stored.build(bank)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = stored.hits("w777")._jdf.queryExecution().executedPlan()
        assert len(plan.executeCollect()) == 1 and "EqualTo(token,w777)" in plan.toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    leaves = plan.collectLeaves()
    read = [leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.length()) if leaves.apply(i).metrics().contains("numOutputRows")]
    assert 0 < read[0] < 60_000 < stored.store.read("postings", stored.postings_schema).count() == 300_000


def test_scan_and_index_agree_on_empty_rows(spark):
    bank = bank_of(spark, {1: "of the sea", 2: None, 3: "of the", 4: "sky"})
    fields = {"text": F.coalesce("text", F.lit(""))}
    score = lambda found: {r.id: round(r.score, 9) for r in search.ranked(bank, "id", fields, "of the", found).collect()}
    assert score(None) == score(search.index(bank, "id", fields))


# --- folds, dependencies, settlement -----------------------------------------------------------


def brute_fold(ops):
    state, out = {}, {}
    for e, i, kind, bv, bh, c, to in sorted(ops):
        v, h, gone, past = state.get(e, (0, None, False, {}))
        outcome, new = "applied", h
        if kind == "create":
            outcome, new = ("rejected", h) if v else ("applied", c)
        elif not v:
            outcome = "rejected"
        elif kind == "delete" and gone or kind == "restore" and not gone:
            outcome = "unchanged"
        elif (bv is not None or bh is not None) and (bv, bh) != (v, h):
            outcome = "stale"
        elif kind in ("update", "revert"):
            new = c if kind == "update" else past.get(to)
            if gone or new is None:
                outcome, new = "rejected", h
            elif new == h:
                outcome = "unchanged"
        if outcome == "applied":
            v, h = v + 1, new
            past = past | {v: h}
            gone = kind == "delete" or gone and kind != "restore"
        state[e] = v, h, gone, past
        out[e, i] = outcome, v, h, gone
    return out


def simulated(rng, n, entities, p_stale):
    """Operations whose bases mostly name what is current; a third and more are of one entity."""
    ops, state = [], {}
    for i in range(n):
        e = 1 if rng.random() < 0.4 else rng.randrange(2, entities)
        v, h, gone = state.get(e, (0, None, False))
        kind = "create" if not v else rng.choice(["update"] * 6 + ["delete", "restore", "revert", "create"])
        c = f"h{rng.randrange(50)}"
        bv, bh = (v, h) if rng.random() > 0.1 else (None, None)
        if bv is not None and rng.random() < p_stale:
            bv = max(0, bv - rng.randint(1, 3))
        op = (e, i, kind, None if kind == "create" else bv, None if kind == "create" else bh, c, rng.randint(1, 40) if kind == "revert" else None)
        ops.append(op)
        state[e] = [x[:3] for x in [brute_fold([o for o in ops if o[0] == e]).get((e, i))[1:]]][0]
    return ops


@pytest.mark.parametrize("p_stale", [0.0, 0.3])
def test_based_fold_spreads_one_entity(spark, p_stale):
    ops = simulated(random.Random(4), 260, 9, p_stale)
    schema = "entity_id long, op_id long, kind string, base_version long, base_hash string, content_hash string, to_version long"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = versions.fold(spark.createDataFrame(ops, schema)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.entity_id, r.op_id): (r.outcome, r.version, r.content_hash, r.deleted) for r in got} == brute_fold(ops)
    assert {r.outcome for r in got} >= {"applied", "rejected", "unchanged"} | ({"stale"} if p_stale else set())


def brute_levels(nodes, edges):
    import functools

    after = {n: {b for a, b in edges if a == n} for n in nodes}
    reach = {n: set(after[n]) for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] = reach[n].union(*[reach.get(b, set()) for b in reach[n]]) if reach[n] else reach[n]
    missing = {n for n in nodes if after[n] - set(nodes)}
    cyclic = {n for n in nodes if n in reach[n]}

    @functools.cache
    def level(n):
        return 1 + max((level(b) for b in after[n]), default=-1)

    out = {}
    for n in nodes:
        bad = "missing" if n in missing else "cycle" if n in cyclic else "blocked" if reach[n] & (missing | cyclic) else None
        out[n] = (None if bad else level(n), bad)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_dependency_levels(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(14))
    fixed = [[(1, 0), (2, 1), (3, 2)], [(3, 1), (3, 2), (1, 0), (2, 0)], [(1, 2), (2, 1), (3, 1), (5, 5), (6, 99)], []][seed]
    edges = sorted({*fixed, *[(rng.choice(nodes), rng.choice(nodes)) for _ in range(6 * (seed > 1) + 4)]}) if seed else fixed
    found = dependencies.levels(spark.createDataFrame([(n,) for n in nodes], "operation_id long"), spark.createDataFrame(edges, "operation_id long, depends_on long"))
    assert {r.operation_id: (r.level, r.problem) for r in found.collect()} == brute_levels(nodes, edges)


def test_rebinding_replaces_edges(spark):
    queue = spark.createDataFrame([("a", "pending"), ("b", "settled")], "operation_id string, state string")
    devices = spark.createDataFrame([("x", "d")], "account_id string, device_id string")
    asked = spark.createDataFrame([("a", "x", "d", ["b", "c"]), ("b", "x", "d", [])], "operation_id string, account_id string, device_id string, dependencies array<string>")
    done = dependencies.bind(queue, devices, asked)
    assert {r.operation_id: r.outcome for r in done.collect()} == {"a": "bound", "b": "notFound"}
    old = spark.createDataFrame([("a", "z"), ("b", "z")], "operation_id string, depends_on string")
    assert rows(dependencies.rebound(old, done)) == [("a", "b"), ("a", "c"), ("b", "z")]


def test_settlement_is_whole_or_nothing(spark, tmp_path):
    kept = settle.Exchanged(spark, str(tmp_path / "tables"))
    op = lambda i, batch="b", state="in_flight": (f"o{i}", "question", f"e{i % 2}", "update", i, "f" * 64, '{"b": 1, "a": 2}', [], batch, state, None, 0, i, None, 1, None, i)
    kept.enqueue(spark.createDataFrame([op(1), op(2), op(3), op(4, "c")], settle.QUEUE))
    good = [("o1", "applied", 2, "a" * 64, None, '{"changeCursor": "s9"}'), ("o2", "conflict", 5, "c" * 64, "x", "{}"), ("o3", "dependencyFailed", None, None, None, "null")]
    frame = lambda x: spark.createDataFrame(x, settle.OUTCOME)
    version = kept.store.manifest()["version"]
    wrong = {
        "missing": good[:2], "unexpected": [*good, ("o4", "noop", None, None, None, "{}")], "repeated": [*good, good[0]],
        "status": [*good[:2], ("o3", "odd", None, None, None, "{}")], "conflict": [good[0], (*good[1][:3], "c", "x", "{}"), good[2]],
    }
    for name, outcomes in wrong.items():
        with pytest.raises(settle.CorruptResponse, match=name):
            kept.settle("b", frame(outcomes), 7)
    assert kept.store.manifest()["version"] == version
    kept.settle("b", frame(good), 7)
    assert {r.operation_id: (r.state, r.error_code) for r in kept.table("queue").collect()} == {
        "o1": ("settled", None), "o2": ("conflict", "SYNC_CONFLICT"), "o3": ("failed", "SYNC_OPERATION_FAILED"), "o4": ("in_flight", None)
    }
    conflict = kept.table("conflicts").collect()
    assert [(c.conflict_id, c.operation_id, c.cloud_version, c.local_snapshot, c.hydration_state) for c in conflict] == [("x", "o2", 5, '{"a":2,"b":1}', "placeholder")]
    assert [(b.entity_id, b.version, b.sequence, b.tombstone) for b in kept.table("baseline").collect()] == [("e1", 2, "s9", False)]
    version = kept.store.manifest()["version"]
    kept.settle("b", frame(good), 8)
    assert kept.store.manifest()["version"] == version
    with pytest.raises(settle.CorruptResponse, match="unexpected"):  # another response to what is settled
        kept.settle("b", frame([(*good[0][:5], '{"changeCursor": "s10"}')]), 9)


# --- blobs and images --------------------------------------------------------------------------


def test_blob_store(spark, tmp_path):
    store = BlobStore(spark, f"file://{tmp_path}/store")
    big = bytes(range(256)) * 700
    cut = lambda name, data, size: [(name, k // size, data[k : k + size]) for k in range(0, max(1, len(data)), size)]
    chunks = [*cut("u1", big, 1000), *cut("u2", big, 70_000), *cut("u3", b"", 10), *cut("u4", b"own", 2)[::-1], cut("u1", big, 1000)[4]]
    bad = [("gap", 0, b"a"), ("gap", 2, b"c"), ("two", 0, b"a"), ("two", 0, b"b")]
    frame = lambda x: spark.createDataFrame(x, "upload_id string, chunk int, data binary").repartition(3)
    got = {r.upload_id: r for r in store.put(frame(chunks + bad)).collect()}
    assert {k: got[k].problem for k in ("gap", "two")} == {"gap": "missing", "two": "conflicting"}
    assert got["u1"].blob_hash == got["u2"].blob_hash == hashlib.sha256(big).hexdigest() and got["u1"].byte_size == len(big)
    assert {k: got[k].outcome for k in ("u1", "u2", "u3", "u4", "gap")} == {"u1": "stored", "u2": "duplicate", "u3": "stored", "u4": "stored", "gap": None}
    files = sorted(Path(tmp_path, "store/blobs").rglob("*.blob"))
    assert len(files) == 3 and all(hashlib.sha256(f.read_bytes()).hexdigest() == f.stem and f.parent.name == f.stem[:2] for f in files)
    again = {r.upload_id: r.outcome for r in store.put(frame([("v1", 0, b"own"), ("v2", 0, b"new")])).collect()}
    assert again == {"v1": "duplicate", "v2": "stored"} and store.verify().count() == 0
    own = hashlib.sha256(b"own").hexdigest()
    attachments = spark.createDataFrame([(1, own, None), (2, own, 5), (3, "0" * 64, None), (4, "odd", None)], "attachment_id long, blob_hash string, deleted_at long")
    assert store.open(attachments, 1) == b"own" and {r.attachment_id for r in store.missing(attachments).collect()} == {3, 4}
    for attachment, error in ((2, KeyError), (9, KeyError), (3, CorruptBlob), (4, CorruptBlob)):
        with pytest.raises(error):
            store.open(attachments, attachment)
    next(f for f in files if f.stem == own).write_bytes(b"oxn")
    with pytest.raises(CorruptBlob):
        store.put(frame([("w", 0, b"own")]))
    assert [r.blob_hash for r in store.verify().collect()] == [own]


def test_large_uploads_are_refused(spark, monkeypatch):
    from paperloom.sources import blobs

    monkeypatch.setattr(blobs, "MAX_BYTES", 5)
    chunks = spark.createDataFrame([("a", 0, b"123"), ("a", 1, b"456"), ("b", 0, b"12345")], "upload_id string, chunk int, data binary")
    assert {r.upload_id: r.problem for r in digests(chunks).collect()}["b"] is None


def test_images_in_documents(spark):
    data = {hashlib.sha256(x).hexdigest(): x for x in (b"one", b"two", b"three")}
    one, two, three = data
    image = lambda h, kind="image/png", caption="a <b>": (h, kind, caption)
    items = [
        (1, 0, "essay", "Q", None, "A", [image(two), image(one, "IMAGE/JPEG")]), (1, 1, "essay", "Q", None, "A", [image(two)]), (1, 2, "essay", "Q", None, "A", None),
        (2, 0, "essay", "Q", None, "A", [image(three)]), (3, 0, "essay", "Q", None, "A", [image(one), image(one, "image/gif")]), (4, 0, "essay", "Q", None, "A", [image(one, "image/svg+xml")]),
        (5, 0, "essay", "Q", None, "A", [image("0" * 64)]),
    ]
    schema = "paper_id long, place int, question_type string, text string, options array<string>, answer string, attachments array<struct<blob_hash:string,media_type:string,caption:string>>"
    items = spark.createDataFrame(items, schema).withColumns({"starts_section": F.col("place") == 0, "marks": F.lit(1.0), "essay_lines": F.lit(1)})
    papers = spark.createDataFrame([(k, f"P{k}", "S", 10, 10) for k in range(1, 7)], "paper_id long, title string, subject string, duration_minutes int, total_marks int")
    blobs = spark.createDataFrame([(h, bytearray(x if h != three else b"changed")) for h, x in data.items()], "blob_hash string, content binary")
    made = {r.paper_id: r for r in export.docx(papers, items, blobs=blobs).collect()}
    assert {k: r.error for k, r in made.items()} == {
        1: None, 2: "blob content does not match its declared SHA-256 hash", 3: "the same blob hash has conflicting media types",
        4: "only supported raster image media types can be exported", 5: "missing blob", 6: None,
    }
    assert all((made[k].package is None) == (made[k].error is not None) for k in made)
    z = zipfile.ZipFile(io.BytesIO(made[1].package))
    parts = [n for n in z.namelist() if n.startswith("word/media/")]
    assert parts == sorted([f"word/media/{two}.png", f"word/media/{one}.jpg"]) and z.read(f"word/media/{one}.jpg") == b"one"
    text = z.read("word/document.xml").decode()
    assert re.findall(r'r:embed="(\w+)"', text) == ["rId1", "rId2", "rId1"] and re.findall(r'docPr id="(\d+)"', text) == ["1", "2", "3"]
    targets = dict(re.findall(r'Id="(\w+)" Type="[^"]*/image" Target="([^"]*)"', z.read("word/_rels/document.xml.rels").decode()))
    assert targets == {"rId1": f"media/{two}.png", "rId2": f"media/{one}.jpg"} and "a &lt;b&gt;" in text
    kinds = z.read("[Content_Types].xml").decode()
    assert 'Extension="png" ContentType="image/png"' in kinds and 'Extension="jpg" ContentType="image/jpeg"' in kinds
    import xml.dom.minidom

    for n in ("[Content_Types].xml", "word/document.xml", "word/_rels/document.xml.rels"):
        xml.dom.minidom.parseString(z.read(n))


def test_folder_sizes(spark):
    files = [("a/b/x", 1), ("a/b/y", 2), ("/a/z", 4), ("top", 8), ("a//c/deep/q", 2**62), ("a//c/deep/r", 2**62)]
    got = {r.folder: (r.files, int(r.bytes)) for r in inventory.folder_sizes(spark.createDataFrame(files, "path string, size long")).collect()}
    all_ = 2**63
    assert got == {"": (6, all_ + 15), "a": (5, all_ + 7), "a/b": (2, 3), "a/c": (2, all_), "a/c/deep": (2, all_)}
    odd = inventory.unsupported_entries(spark.createDataFrame([("a", "file"), ("b", "link"), ("c", None)], "path string, kind string"))
    assert rows(odd) == [("b", "symbolic link"), ("c", "unsupported file type")]

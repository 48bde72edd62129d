"""Conflicts, batches, marks, folds and papers against plain state machines."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.operators import conflicts, export, generate, inventory, outbox, papers, search, versions


def resolved_by_force(stored, events):
    """One conflict's decisions, one after another."""
    state = {c: {"v": v, "h": h, "ready": r == "complete", "state": "unresolved", "ops": {}} for c, v, h, r in stored}
    out = {}
    for c, seq, kind, op, action, v, h, q, r, av, ah in sorted(events, key=lambda e: e[1]):
        s = state.get(c)
        if kind == "stage":
            if s is None:
                out[seq] = "notFound"
            elif op in s["ops"]:
                out[seq] = "existing" if s["ops"][op]["q"] == q else "rejected"
            elif not s["ready"]:
                out[seq] = "notReady"
            elif (s["v"], s["h"]) != (v, h):
                out[seq] = "stale"
            elif s["state"] != ("resolved" if action == "undo" else "unresolved"):
                out[seq] = "unavailable"
            else:
                out[seq] = "staged"
                s["ops"][op], s["state"] = {"q": q, "action": action, "r": None}, "resolving"
            continue
        o = s and s["ops"].get(op)
        if not o:
            out[seq] = "notFound"
        elif o["r"] is not None:
            out[seq] = "replayed" if o["r"] == r else "corrupt"
        elif o["action"] != action:
            out[seq] = "rejected"
        else:
            out[seq], o["r"] = "accepted", r
            s["state"] = "undone" if action == "undo" else "resolved"
            if action != "saveCopy":
                s["v"], s["h"] = av, ah
    return out, {c: (s["state"], s["v"], s["h"]) for c, s in state.items()}


def test_resolutions_by_force(spark):
    rng = random.Random(4)
    stored = [(c, 1, "h1", "pending" if c == 3 else "complete") for c in range(1, 40)]
    events = []
    for seq in range(3000):
        c, v, av = rng.randrange(42), rng.randint(1, 2), rng.randint(1, 2)
        events.append((
            c, seq, rng.choice(["stage", "settle"]), c * 10 + rng.randrange(4), rng.choice(["undo", "saveCopy", "keepLocal"]), v, f"h{v}",
            f"q{rng.randrange(2)}", f"r{rng.randrange(2)}", av, f"h{av}",
        ))
    schema = "conflict_id long, seq long, kind string, operation_id long, action string, version long, content_hash string, request_hash string, response_hash string, accepted_version long, accepted_hash string"
    got = conflicts.resolve(spark.createDataFrame(stored, "conflict_id long, cloud_version long, cloud_hash string, hydration string"), spark.createDataFrame(events, schema)).collect()
    outcomes, states = resolved_by_force(stored, events)
    assert {r.seq: r.outcome for r in got} == outcomes
    assert {"staged", "existing", "rejected", "stale", "unavailable", "accepted", "replayed", "corrupt", "notReady", "notFound"} == set(outcomes.values())
    assert {r.conflict_id: (r.state, r.cloud_version, r.cloud_hash) for r in got if r.conflict_id in states} == {c: states[c] for c in {e[0] for e in events} & set(states)}
    assert {s for s, *_ in states.values()} >= {"undone", "resolved", "unresolved"}


def test_conflict_rules(spark):
    h = "a" * 64
    rows = [
        (1, "question", "concurrentCreate", "{}", "{}", 1, h, None, None),
        (2, "question", "concurrentCreate", "{}", "{}", 1, h, 1, h),
        (3, "paper", "divergentContent", "{}", "{}", 1, h, 1, h),
        (4, "paper", "divergentContent", "{}", "{}", 1, h, None, None),
        (5, "folder", "other", None, None, 0, "x", 1, "y"),
    ]
    names = "conflict_id int, entity_type string, reason string, local string, cloud string, cloud_version int, cloud_hash string, base_version int, base_hash string"
    got = {r.conflict_id: len(r.errors) for r in conflicts.conflict_errors(spark.createDataFrame(rows, names)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 7}


def test_marks_by_force(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for key in range(120):
        n = rng.randint(1, 9)
        total = rng.choice([n, n + rng.randint(0, 6), rng.randint(1, 100)])
        weights = [rng.choice([0.001, 0.5, 1.0, 2.0, 60.0]) for _ in range(n)]
        rows += [(key, i, w, total) for i, w in enumerate(weights)]
        w = [max(x, 0.01) for x in weights]
        raw = [max(total * x / sum(w), 1.0) for x in w]
        marks = [int(x) for x in raw]
        order = sorted(range(n), key=lambda i: (-(raw[i] - int(raw[i])), i))
        left, k = total - sum(marks), 0
        while left and total >= n:
            i = order[k % n]
            if left > 0:
                marks[i], left = marks[i] + 1, left - 1
            elif marks[i] > 1:
                marks[i], left = marks[i] - 1, left + 1
            k += 1
        want |= {(key, i): marks[i] if total >= n else None for i in range(n)}
    got = generate.apportion(spark.createDataFrame(rows, "k int, i int, w double, t int"), "k", "i", "w", "t").collect()
    assert {(r.k, r.i): r.marks for r in got} == want


def test_window_fold_equals_the_state_machine(spark):
    rng = random.Random(5)
    rows = [(e, 100 * e + k, rng.choice(["create", "update", "update", "delete", "restore"]), None, None, rng.choice(["a", "b", None]), None) for e in range(60) for k in range(rng.randint(1, 25))]
    df = spark.createDataFrame(rows, "entity_id long, op_id long, kind string, base_version long, base_hash string, content_hash string, to_version long")
    assert sorted(map(tuple, versions.fold(df).collect())) == sorted(map(tuple, versions._based_fold(df).collect()))


def test_cursors_and_recovery(spark):
    steps = [(1, 1, "stage", "a"), (1, 2, "stage", "b"), (1, 3, "commit", None), (1, 4, "commit", None), (1, 5, "stage", "c"), (2, 1, "commit", None), (3, 1, "stage", "z")]
    got = {r.device: (r.pulled_cursor, r.acknowledged_cursor) for r in outbox.cursors(spark.createDataFrame(steps, "device int, seq int, kind string, cursor string"), "device").collect()}
    assert got == {1: ("c", "b"), 2: (None, None), 3: ("z", None)}
    q = spark.createDataFrame([("applying",), ("ready",), ("in_flight",)], "state string")
    once = outbox.recovered("rebuilds", q)
    assert Counter(r.state for r in once.collect()) == {"ready": 2, "in_flight": 1}
    assert sorted(outbox.recovered("rebuilds", once).collect()) == sorted(once.collect())
    assert outbox.recovery_counts({"rebuilds": q, "operations": q}).first() == (1, 1)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "The", "of", "öf", "war", "x-ray"]) for _ in range(rng.randint(0, 12))) for _ in range(80)] + [None, "the the the"]
    bank = spark.createDataFrame([(i, t, "src of", ["the", "Art"]) for i, t in enumerate(texts)], "id int, text string, source string, tags array<string>")
    fields = search.document_fields(subjects=None)
    search.write_index(search.index(bank, "id", fields), str(tmp_path / "index"))
    found = spark.read.parquet(str(tmp_path / "index"))
    for phrase in ("of the", "the the", "x ray", "THE ART", "of", "none such"):
        a = {r.id: round(r.score, 9) for r in search.ranked(bank, "id", fields, phrase).collect()}
        b = {r.id: round(r.score, 9) for r in search.ranked(bank, "id", fields, phrase, found).collect()}
        assert a == b, phrase
    hits = {r.id: r.hits for r in search.index_hits(found, "the the").collect()}
    assert hits[81] == 2 and all(texts[i] and len(texts[i].split()) > 1 for i in hits)


def test_tex_document(spark):
    own = spark.createDataFrame([(1, "A & B", "Maths", 90, "10.50"), (2, "Empty", "x_y", 5, "3.0")], "paper_id int, title string, subject string, duration_minutes int, total_marks string")
    rows = [
        (1, 0, True, "true_false", "50% of $x_1$?", "3.0", ["a_b", "100%"], "a_b", None, [("images/h.png", "Fig_1")]),
        (1, 1, True, "blank", "Say __", None, [], "ok", None, []),
        (1, 2, False, "essay", "Why?", "7.5", None, "", 3, None),
    ]
    items = spark.createDataFrame(rows, "paper_id int, place int, starts_section boolean, question_type string, text string, marks string, options array<string>, answer string, essay_lines int, images array<struct<path:string,caption:string>>")
    got = {r.paper_id: r.content for r in export.tex(own, items).collect()}
    body = got[1].split("\\vspace{0.8em}\n")[1]
    assert body == "\n".join([
        r"\section*{True or False}", r"\begin{enumerate}", r"\item 50\% of $x_1$? \hfill \textit{[3 marks]}",
        r"\begin{enumerate}[label=\Alph*.,itemsep=0.2em]", r"\item a\_b", r"\item 100\%", r"\end{enumerate}",
        r"\begin{center}", r"\includegraphics[width=0.75\linewidth]{\detokenize{images/h.png}}", r"\\{\small Fig\_1}", r"\end{center}",
        r"\end{enumerate}", r"\section*{Fill in the Blank}", r"\begin{enumerate}", r"\item Say \_\_", r"\item Why? \hfill \textit{[7.5 marks]}", r"\vspace{1.65cm}",
        r"\end{enumerate}", r"\end{document}", "",
    ])
    assert r"{\LARGE\bfseries A \& B}\\[0.6em]" in got[1] and "Total Marks: 10.5\n" in got[1]
    assert got[2].endswith("\\vspace{0.8em}\n\\end{document}\n") and r"x\_y" in got[2]
    told = export.tex(own, items, answers=True).where("paper_id = 1").first().content
    assert r"\par\textcolor{blue}{\textbf{Answer:} a\_b}" in told and r"\vspace{1.65cm}" not in told
    blobs = spark.createDataFrame([("h", bytearray(b"png"))], "blob_hash string, bytes binary")
    held = spark.createDataFrame([(1, [("images/h.png", "h"), ("images/h.png", "h"), ("images/g.png", "g")])], "paper_id int, images array<struct<path:string,blob_hash:string>>")
    found, missing = export.companions(held, blobs)
    assert [(r.path, bytes(r.bytes)) for r in found.collect()] == [("images/h.png", b"png")] and [r.path for r in missing.collect()] == ["images/g.png"]


def test_papers_attachments_and_paths(spark):
    own = spark.createDataFrame([(1, " ", 0, "5"), (2, "t", 9, "5"), (3, None, None, None)], "paper_id int, title string, duration_minutes int, total_marks string")
    items = spark.createDataFrame([(1, 0, 2.0), (2, 1, -1.0)], "paper_id int, item_order int, marks double")
    got = {r.paper_id: len(r.errors) for r in papers.paper_errors(own, items).collect()}
    assert got == {1: 2, 2: 3, 3: 3}
    names = [("a.png", "image/png"), ("../a", "image/png"), ("a", "Image"), ("", "a/b"), (None, None)]
    df = spark.createDataFrame(names, "n string, m string")
    assert [len(r[0]) for r in df.select(S.attachment_errors(F.col("n"), F.col("m"))).collect()] == [0, 1, 1, 1, 2]
    paths = [("a/b.png", True), ("/a", False), ("a/../b", False), ("a\\b", False), ("C:/x", False), ("a//b", False), ("", False), (None, False)]
    df = spark.createDataFrame(paths, "p string, ok boolean")
    assert [r[0] for r in df.select(S.safe_archive_path(F.col("p"))).collect()] == [ok for _, ok in paths]
    files = spark.createDataFrame([("k", 5), ("k", 2**62), ("k", 2**62), ("l", 1)], "key string, size long")
    assert {r.key: (int(r.total), r.error) for r in inventory.payload_totals(files, 10, 20, "key").collect()} == {"k": (2**63 + 5, "file too large"), "l": (1, None)}

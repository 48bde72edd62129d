"""Revisits, url filters, images and the pipeline against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import images, urlfilter, warc
from paperloom.llm.queries import URL_RULES


def test_canonical_url(spark):
    rows = [
        ("HTTP://WWW.Ex.org:80/a/?utm_source=x&b=2&a=1#f", "ex.org/a?a=1&b=2"),
        ("https://ex.org/a", "ex.org/a"),
        ("https://ex.org", "ex.org"),
        ("https://ex.org/?ref=1", "ex.org"),
        ("nothing", None),
        (None, None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "u string, w string").select(warc.canonical_url(F.col("u"))).collect()]
    assert got == [w for _, w in rows]


def test_revisits_by_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        url = f"http://h.org/{'hot' if rng.random() < 0.5 else rng.integers(12)}"
        kind = "revisit" if rng.random() < 0.6 else "response"
        tag = [None, f'"{rng.integers(2)}"', f'W/"{rng.integers(2)}"'][rng.integers(3)]
        head = {"etag": tag} if tag else {}
        if rng.random() < 0.5:
            head["last-modified"] = f"m{rng.integers(2)}"
        head["content-length"] = str(i)
        when = None if i % 37 == 0 else int(rng.integers(60))
        rows.append((i, kind, None if i % 41 == 0 else url, when, 404 if i % 11 == 0 and kind == "response" else 200, head, "extra"))
    schema = "record_id long, warc_type string, target_uri string, captured long, status int, headers map<string,string>, url string"
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    strip = lambda t: t.removeprefix("W/") if t else None
    for i, kind, url, when, _, head, _ in rows:
        if kind != "revisit":
            continue
        older = [
            (r[3], r[0], r[5]) for r in rows
            if r[1] == "response" and r[4] == 200 and url and r[2] == url and when is not None and r[3] is not None and (r[3], r[0]) < (when, i)
        ]
        if not older:
            want = ("orphan", None)
        else:
            _, rid, theirs = max(older, key=lambda x: x[:2])
            a, b = strip(head.get("etag")), strip(theirs.get("etag"))
            c, d = head.get("last-modified"), theirs.get("last-modified")
            kind = "etag" if a and a == b else "mismatch" if a and b else "last-modified" if c and c == d else "mismatch" if c and d else "unvalidated"
            want = (kind, rid if kind in ("etag", "last-modified") else None)
        assert (got[i].outcome, got[i].resolved_id) == want
        if want[1] is not None:
            assert got[i].headers["content-length"] == str(want[1])
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_hosts_paths_and_rules(spark):
    rows = [
        (0, "http://A.Example.ORG/en/1x?q#f", "a.example.org", "/en/1x", "example.org/en/1", "block"),
        (1, "https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        (2, "x://b.com?x", "b.com", "", None, "allow"),
        (3, "http://borg/es/", "borg", "/es/", None, "allow"),
        (4, "http://c.com/de/a://b/fr/", "c.com", "/de/a://b/fr/", "com/de/", "block"),
        (5, "no url", "", "", None, "allow"),
        (6, None, "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(r[0], r[1], None, "clash") for r in rows], "page_id int, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, URL_RULES).collect()}
    assert got == {r[0]: r[2:] for r in rows}
    assert urlfilter.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_propagation_by_force(spark):
    rng = np.random.default_rng(5)
    hosts = [f"h{i}" for i in range(30)]
    edges = sorted({(hosts[a], hosts[b], float(1 + (a + b) % 3)) for a, b in rng.integers(0, 30, (90, 2)) if a != b})
    seeds = [("h0", 1.0, 0.0), ("h1", 0.5, 0.25), ("h2", 0.0, 1.0)]
    got = urlfilter.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trusted double, blocked double"))
    got = {r.host: (r.trust, r.distrust) for r in got.collect()}
    n = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((30, 30))
    for a, b, w in edges:
        m[n[a], n[b]] = w
    for k, a in enumerate((m, m.T)):
        p = a / np.maximum(a.sum(1, keepdims=True), 1e-12)
        seed = np.zeros(30)
        for h, *v in seeds:
            seed[n[h]] = v[k]
        seed /= seed.sum()
        rank = seed
        for _ in range(urlfilter.steps_for()):
            rank = 0.15 * seed + 0.85 * rank @ p
        for h in hosts:
            assert abs(got.get(h, (0, 0))[k] - rank[n[h]]) < 1e-9


def test_links_reach_hosts(spark):
    html = '<a href="//rel.net/z">0</a><a href="http://bad.net/x">1</a><a HREF=\'https://bad.net/y\'>2</a><a href="/own">3</a>'
    df = spark.createDataFrame([(1, "http://seed.com/de/1", None), (2, "http://linker.net/a", html.replace("bad.net", "seed.com")), (3, "http://far.info/", None)], "page_id int, url string, html string")
    edges = {(r.src, r.dst): r.weight for r in urlfilter.host_edges(df).collect()}
    assert edges[("linker.net", "seed.com")] == 1.0 and edges[("linker.net", "rel.net")] == 1.0
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(df, URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_image_copies(spark):
    rng = np.random.default_rng(8)
    art = [np.kron(rng.integers(0, 255, (9, 9)), np.ones((8, 8))).astype(np.uint8) for _ in range(40)]
    rows = [(i, images.pgm(a), "extra") for i, a in enumerate(art)]
    rows += [(100, rows[3][1], "copy"), (101, None, ""), (102, b"junk", ""), (103, images.pgm(np.zeros((5, 5))), ""), (None, rows[0][1], "")]
    asked = [(i, images.pgm(np.round(art[i][5:63, 7:66] * 0.8 + 20))) for i in range(0, 40, 4)] + [(500, None), (501, images.pgm(rng.integers(0, 255, (72, 72))))]
    media = spark.createDataFrame(rows, "image_id long, image binary, bits string")
    queries = spark.createDataFrame(asked, "image_id long, image binary")
    got = images.find_copies(queries, media).collect()
    right = [r for r in got if r.query_id == r.image_id]
    assert len(right) == 10 and len(got) == 10  # each crop finds its source, and nothing else
    assert all(abs(r.dx - 7) <= 1 and abs(r.dy - 5) <= 1 for r in right)
    by_force = set()
    described = {i: images.describe(images.read_pgm(b)[None])[0] for i, b, _ in rows[:40]}
    for q, b in asked[:10]:
        d = images.describe(images.read_pgm(b)[None])[0]
        for i, e in described.items():
            if images.agreement(d["bits"].tobytes(), d["numbers"].tobytes(), e["bits"].tobytes(), e["numbers"].tobytes())[0] >= images.MIN_AGREE:
                by_force.add((q, i))
    assert {(r.query_id, r.image_id) for r in got} == by_force
    assert images.find_copies(queries, media.limit(0)).count() == 0
    same = images.find_copies(spark.createDataFrame([(3, rows[3][1])], "image_id long, image binary"), media).collect()
    assert [(r.image_id, r.class_size) for r in same] == [(3, 2)]


def test_image_copies_on_large_images(spark):
    """Crops whose corners are the weakest of the image; small shares of equal bands."""
    rng = np.random.default_rng(3)
    art = rng.integers(118, 138, (6, 24, 24))
    art[:, :12] = rng.integers(0, 255, (6, 12, 24))  # the strong corners lie in the upper half
    art = [np.kron(a, np.ones((8, 8))).astype(np.uint8) for a in art]
    media = spark.createDataFrame([(i, images.pgm(a)) for i, a in enumerate(art)], "image_id long, image binary")
    asked = [(i, images.pgm(a[125:185, 60 + i : 120 + i])) for i, a in enumerate(art)]
    got = images.find_copies(spark.createDataFrame(asked, "image_id long, image binary"), media).collect()
    assert {(r.query_id, r.image_id) for r in got} == {(i, i) for i in range(6)}
    assert all(abs(r.dx - 60 - r.query_id) <= 1 and abs(r.dy - 125) <= 1 for r in got)


def test_image_copies_meet_within_the_bits_that_count(spark, monkeypatch):
    """Descriptors that differ in seven bands of eight still meet, as does a pair that shares one band only."""
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 1 << 32, (4, images.BANDS), np.uint64).astype("<u4")
    place = np.array([[20 + 9 * k, 30 + 5 * k, 0, 1] for k in range(4)], np.float32)
    near, far = bits.copy(), bits ^ np.uint32(1)
    for k in range(4):
        near[k, np.arange(8) != k] ^= np.uint32(1 << k)
    rows = [(1, near.tobytes(), place.tobytes()), (2, far.tobytes(), place.tobytes())]
    points = spark.createDataFrame(rows, images.POINTS)
    asked = spark.createDataFrame([(7, bits.tobytes(), place.tobytes())], images.POINTS)
    tables = iter([points, asked])
    monkeypatch.setattr(images, "descriptors", lambda *a: next(tables))
    media = spark.createDataFrame([(1, b"a"), (2, b"b")], "image_id long, image binary")
    got = images.find_copies(media.limit(0), media).collect()
    assert {(r.query_id, r.image_id, r.agreeing) for r in got} == {(7, 1, 4)}


def test_near_copies_are_not_joined_band_by_band(spark, monkeypatch, tmp_path):
    """Queries that share bands are one list, an image meets a list once, and pairs without enough matches do not vote."""
    rng = np.random.default_rng(12)
    common, own = (rng.integers(0, 1 << 32, n, np.uint64).astype("<u4") for n in ((6, images.BANDS), (40, 6, images.BANDS)))
    place = rng.uniform(20, 60, (6, 4)).astype(np.float32)
    place[:, 2:] = (0, 1)
    row = lambda i, bits: (i, np.ascontiguousarray(bits).tobytes(), place.tobytes())
    one = lambda k: np.concatenate([common[:1], own[k][1:]])  # noqa: E731  one corner of the common ones, so too few to agree
    asked = spark.createDataFrame([*[row(i, common) for i in range(9)], row(20, own[0])], images.POINTS)
    points = spark.createDataFrame([*[row(i, common) for i in range(12)], *[row(30 + k, one(k)) for k in range(1, 5)], row(50, own[0]), row(60, own[9])], images.POINTS)
    lists = images.band_lists(asked).collect()
    assert sorted((x.queries, len(x.bands)) for x in lists) == [(list(range(9)), 48), ([20], 48)]
    found = images.meeting(images.band_lists(asked), points).collect()
    want = {(q, i) for q in range(9) for i in [*range(12), 31, 32, 33, 34]} | {(20, 50)}
    assert {(r.query_id, r.id) for r in found} == want and len(found) == len(want)
    path, whole = str(tmp_path / "voted"), images.agreement

    def counted(*both):
        with open(path, "a") as f:
            f.write("1\n")
        return whole(*both)

    tables = iter([points, asked])
    monkeypatch.setattr(images, "descriptors", lambda *a: next(tables))
    monkeypatch.setattr(images, "agreement", counted)
    media = spark.createDataFrame([(r.id, bytes([r.id])) for r in points.collect()], "image_id long, image binary")
    got = images.find_copies(media.limit(0), media).collect()
    assert {(r.query_id, r.image_id, r.agreeing) for r in got} == {(q, i, 6) for q in range(9) for i in range(12)} | {(20, 50, 6)}
    assert len(open(path).read().split()) == 9 * 12 + 1  # and not the 36 pairs of one common corner


def test_best_copies_has_a_row_for_each_query(spark):
    rng = np.random.default_rng(6)
    art = [np.kron(rng.integers(0, 255, (9, 9)), np.ones((8, 8))).astype(np.uint8) for _ in range(6)]
    media = spark.createDataFrame([(i, images.pgm(a), "n") for i, a in enumerate([*art, art[2]])], "image_id long, image binary, n_images string")
    asked = [(i, images.pgm(art[i][4:66, 3:67])) for i in (1, 2)] + [(50, None), (None, images.pgm(art[0])), (51, images.pgm(rng.integers(0, 255, (72, 72)).astype(np.uint8)))]
    got = {r.query_id: r for r in images.best_copies(spark.createDataFrame(asked, "image_id long, image binary"), media).collect()}
    assert sorted(got) == [1, 2, 50, 51]
    assert [(got[q].image_id, got[q].class_size, got[q].n_images) for q in (1, 2)] == [(1, 1, 1), (2, 2, 2)]
    assert got[50].image_id is None and got[50].n_classes == 0 and got[51].n_images == 0




def pictures(n, seed=5):
    """Grey pictures with structure at several sizes."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        x = np.zeros((128, 128), np.float32)
        for cells, weight in ((4, 1.0), (8, 1.0), (16, 0.8), (32, 0.5)):
            x += weight * np.kron(rng.normal(0, 1, (cells, cells)), np.ones((128 // cells, 128 // cells)))
        out.append(np.clip(127 + 45 * images._box(x[None], 1)[0], 0, 255))
    return out


def drawn(image, scale, degrees, side):
    """A scaled and turned view of the middle of an image."""
    a = np.deg2rad(degrees)
    c, s = np.cos(a) / scale, np.sin(a) / scale
    y, x = np.mgrid[0:side, 0:side] - (side - 1) / 2
    sx, sy = c * x - s * y + (image.shape[1] - 1) / 2, s * x + c * y + (image.shape[0] - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    return image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x0 + 1] * fx * (1 - fy) + image[y0 + 1, x0] * (1 - fx) * fy + image[y0 + 1, x0 + 1] * fx * fy


def test_recall_of_edited_copies(spark):
    """Scaled, turned, noisy and blurred copies: at least nine of ten of each kind find their source, and no query another picture."""
    rng = np.random.default_rng(9)
    art = pictures(20)
    part = lambda x: x[10:106, 14:118]
    edits = {
        "crop": part, "darker": lambda x: part(x) * 0.85 + 12, "noise 2": lambda x: part(x) + rng.normal(0, 2, (96, 104)), "noise 5": lambda x: part(x) + rng.normal(0, 5, (96, 104)),
        "blur": lambda x: images._box(part(x)[None], 1)[0], "scale 0.9": lambda x: drawn(x, 0.9, 0, 100), "scale 0.8": lambda x: drawn(x, 0.8, 0, 96), "scale 0.65": lambda x: drawn(x, 0.65, 0, 80),
        "turn 10": lambda x: drawn(x, 1, 10, 88), "turn 30": lambda x: drawn(x, 1, 30, 88), "turn 45": lambda x: drawn(x, 1, 45, 88), "turn 90": lambda x: np.rot90(part(x)), "both": lambda x: drawn(x, 0.85, 20, 84),
    }
    pgm = lambda x: images.pgm(np.clip(np.round(x), 0, 255))
    media = spark.createDataFrame([(i, pgm(x)) for i, x in enumerate(art)], "image_id long, image binary").repartition(4)
    asked = [(1000 * k + i, pgm(f(x))) for k, f in enumerate(edits.values()) for i, x in enumerate(art)]
    asked += [(90_000 + i, pgm(x)) for i, x in enumerate(pictures(20, 77))]  # of nothing in the table
    got = images.find_copies(spark.createDataFrame(asked, "image_id long, image binary").repartition(4), media).collect()
    for k, name in enumerate(edits):
        right = sum(r.query_id == 1000 * k + r.image_id for r in got)
        assert right >= 18, (name, right)
    wrong = [r for r in got if r.query_id % 1000 != r.image_id or r.query_id >= 90_000]
    assert len(wrong) <= len(asked) // 100


def test_a_repeating_image_is_quick():
    """Equal corners in rows and columns, as in wallpaper: votes are linear in matches."""
    import time

    rng = np.random.default_rng(5)
    tile = np.kron(rng.integers(0, 255, (8, 8)), np.ones((4, 4)))
    d = images.describe(np.tile(tile, (8, 8))[None].astype(np.uint8))[0]
    assert len(d["bits"]) > 1500
    began = time.process_time()
    votes, dx, dy = images.agreement(d["bits"].tobytes(), d["numbers"].tobytes(), d["bits"].tobytes(), d["numbers"].tobytes())
    assert votes > 0.9 * len(d["bits"]) and abs(dx % 32) < 1 and abs(dy % 32) < 1
    assert time.process_time() - began < 5

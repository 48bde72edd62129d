"""Manifest, exact dedup and resampling against brute force, with nulls, ties, repeated rows, hot keys, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm import cluster, exact, merkle, resample

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, sha256 string, score int"


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(700):
        lang = rng.choice(["en", "en", "en", "de", "é", None])
        text = " ".join(rng.choice(["Ab", "ça", "x1", "É", "the", "the\t", "\n"]) for _ in range(rng.choice([0, 1, 3, 30])))
        rows.append((i, rng.choice(["s", None]), lang, rng.choice([None, i]), rng.choice([text, text, None]), "l", "s", 1))
    hot = (5000, "s", "en", 3, "Hot text, a third of all rows", "l", "s", 1)
    rows += [(5000 + i % 3, *hot[1:]) for i in range(350)]  # copies, with repeated ids and repeated rows
    rows += [(None, None, None, None, None, None, None, None)] * 2 + [(9000, "s", "only one", 1, "x" * 200_000, "l", "s", 1), (-7, "", "", 0, "", "", "", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, source, lang, n_chars, text, *_):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)])


def tree(leaves, arity):
    """Levels of a tree, and its root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([digest(*now[k : k + arity]) for k in range(0, len(now), arity)])
    return levels


def siblings(levels, at, arity):
    out = []
    for level in levels[:-1]:
        run = at // arity * arity
        out += level[run:at] + level[at + 1 : run + arity]
        at //= arity
    return out


@pytest.mark.parametrize("arity", [8, 2])
def test_manifest(spark, docs, arity):
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    got = merkle.manifest(docs, arity=arity, also={"score": F.col("doc_id") * 2})
    got = got.withColumns({"p": merkle.siblings_digest(F.col("proof")), "f": merkle.folded(F.col("leaf"), F.col("proof"))}).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(corpus()) and len({r.root for r in got}) == 1
    assert all(r.f == r.root and r.score == (None if r.doc_id is None else r.doc_id * 2) for r in got)
    by_lang = defaultdict(list)
    for r in corpus():
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r)))
    # Rows that share an id are equal rows here, so their order is no matter.
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    own = {k: tree([x[2] for x in sorted(v)], arity) for k, v in by_lang.items()}
    top = tree([own[k][-1][0] for k in order], arity)
    assert got[0].root == top[-1][0]
    want = Counter()
    for n, k in enumerate(order):
        above = siblings(top, n, arity)
        for at, x in enumerate(own[k][0]):
            want[x, own[k][-1][0], digest(*siblings(own[k], at, arity), *above)] += 1
    assert Counter((r.leaf, r.subroot, r.p) for r in got) == want


def test_manifest_finds_a_changed_row_and_takes_no_rows(spark, docs):
    made = merkle.manifest(docs.where("doc_id < 300"), also={"other": merkle.leaf(*[F.lit("x") if c == "source" else F.col(c) for c in merkle.COLUMNS])})
    bad = made.where(merkle.folded(F.col("other"), F.col("proof")) == F.col("root")).count()
    assert bad == 0
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = merkle.manifest(docs.where("doc_id = 9000")).collect()
    assert one[0].root == one[0].leaf == one[0].subroot and one[0].proof == []


def test_forests_join_in_any_order():
    """The join of forests is associative: any grouping of ranges gives one root and the same runs."""
    leaves = [(k, digest(str(k))) for k in range(75)]

    def forest(some):
        f = merkle.Forest(1, 4)
        for k, d in some:
            f.add(0, 75, 0, k, (d, 0, 0))
        return f.collapse()

    def join(a, b):
        f = merkle.Forest(1, 4)
        f.sizes[0] = 75
        for x in (a, b):
            f.runs |= x.runs
            for (t, lv), here in x.nodes.items():
                for at, node in here.items():
                    f.add(t, x.sizes[t], lv, at, node)
        return f.collapse()

    cuts = [0, 3, 10, 31, 32, 60, 75]
    parts = [forest(leaves[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    left = parts[0]
    for p in parts[1:]:
        left = join(left, p)
    right = join(join(parts[4], parts[5]), join(parts[1], join(parts[3], join(parts[0], parts[2]))))
    open_ = lambda f: {k: v for k, v in f.nodes.items() if v}
    assert open_(left) == open_(right) and left.runs == right.runs
    assert left.nodes[merkle.TOP, 0][0][0] == tree([d for _, d in leaves], 4)[-1][0]


def exact_brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, len(text or "")))
    out = {}
    for body, own in groups.items():
        best = max(n for _, n in own)
        ids = [i for i, n in own if n == best]
        keep = min([i for i in ids if i is not None], default=None)
        out[hashlib.sha256(body.encode()).hexdigest()] = (keep, len(own))
    return out


@pytest.mark.parametrize(
    "options",
    [{}, {"key_of": lambda body: F.octet_length(body).cast("long")}, {"key_of": lambda body: F.lit(-1).cast("long")}, {"capacity": 40}],
    ids=["hash", "colliding", "one key", "many buckets"],
)
def test_exact(docs, options):
    got = exact.judged(docs, **options).collect()
    want = exact_brute([(r[0], r[4]) for r in corpus()])
    assert len(got) == len(corpus())
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(want, 1)) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_index_files(spark, docs):
    """Buckets are disjoint ranges of keys, no deeper than the directory, and over their capacity only at one key or the last depth."""
    scratch = cluster.Scratch(spark)
    index = exact.build(docs, scratch, capacity=2000)
    slots = index.directory.collect()
    width = 1 << (exact.MAX_DEPTH - index.depth)
    for s in slots:
        assert s.depth <= index.depth and s.bucket <= s.slot * width < s.bucket + (1 << (exact.MAX_DEPTH - s.depth))
    assert len({s.bucket for s in slots}) > 1
    for e in index.entries.collect():
        slot = (e.key & (2**64 - 1)) >> (64 - index.depth) if index.depth else 0
        assert e.bucket == next(s.bucket for s in slots if s.slot == slot)
    fill = index.entries.groupBy("bucket").agg(F.sum(F.octet_length("body")).alias("b"), F.count("*").alias("n")).collect()
    depth = {s.bucket: s.depth for s in slots}
    assert all(f.b <= 2000 or f.n == 1 or depth[f.bucket] == exact.MAX_DEPTH for f in fill)
    scratch.keep_only()
    assert exact.judged(docs.limit(0)).collect() == []


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("n_max", [1, 3])
def test_resample(spark, docs, n_max):
    target = spark.createDataFrame([(1, "the x1 the ÇA ça"), (2, None), (3, "")], "item_id long, text string")
    buckets = 50
    got = resample.resample(docs, target, n_max=n_max, buckets=buckets, percent=25).collect()

    def grams(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for r in corpus() for g in grams(r[4]))
    t = Counter(bucket(g) for x in ("the x1 the ÇA ça", "", "") for g in grams(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + float(buckets)) / ((s[b] + 1.0) * (T + float(buckets))))) for b in range(buckets)]
    rows = []
    for i, _, _, _, text, *_ in corpus():
        g = grams(text)
        weight = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = 25 * len(able) // 100
    assert drawn > 3
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(r[:4] for r in rows)
    ranks = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert [(k, i, sc) for k, i, sc in ranks] == [(k + 1, r[0], r[3]) for k, r in enumerate(able[:drawn])]
    assert resample.resample(docs.limit(0), target).collect() == []
    assert resample.resample(docs.where("doc_id = 3"), target.limit(0)).count() == 1

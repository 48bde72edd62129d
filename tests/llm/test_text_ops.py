"""Ops on texts against brute force, with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, jaccard, kernels, packing, quality, rules, sharding, substring

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, source string, _x int, n_words string, score string"


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}é" for i in range(60)] + ["The", "of", "a|b", "x!"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = make(200)
    passage = make(45)
    texts = [None, "", " \n\t ", "one", "one two three four", "ONE two three four", base, base]
    for k in range(12):
        w = base.split()
        for _ in range(k * 2):
            w[rng.randrange(len(w))] = make(1)
        texts.append(" ".join(w))
    texts += [make(30) + "\n" + passage + "  " + make(40) for _ in range(8)]
    texts += [make(n) for n in (19, 20, 21, 5, 6, 300)] + ["same words again " * 60, "a\n\nb\na\n" * 30, make(9000)]
    return [(i * 3, t, f"s{i % 2}" if i % 5 else None, i, "n", "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(WORD, text or "")


def test_substring(spark, docs):
    seen, want = set(), {}
    for i, t, *_ in corpus():
        w = words(t)
        gone = set()
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone |= set(range(j, j + 20))
            seen.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = substring.dedup_substrings(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got} == want
    assert any(v[1] for v in want.values()) and got[0]._x is not None
    assert substring.dedup_substrings(empty(spark)).count() == 0


def test_substring_null_and_repeated_ids(spark):
    text = " ".join(f"q{i}" for i in range(25))
    rows = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    got = substring.dedup_substrings(rows).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 25), (1, 0), (1, 25)]


def unmix(x):
    """The inverse of ``kernels.mix``."""
    m = 2**64 - 1
    inverse = lambda a: pow(a, -1, 2**64)
    x ^= (x >> 31) ^ (x >> 62)
    x = x * inverse(0x94D049BB133111EB) & m
    x ^= (x >> 27) ^ (x >> 54)
    x = x * inverse(0xBF58476D1CE4E5B9) & m
    return x ^ (x >> 30) ^ (x >> 60)


def colliding_words(seed, n):
    """Pairs of 16-byte words that the first seed confuses under the key 0: the second halves differ by what the first ones do."""
    import numpy as np

    assert all(unmix(int(kernels.mix(np.array([v], np.uint64))[0])) == v for v in (0, 1, 2**64 - 1, 12345678901234567890))
    start = kernels._SEEDS[0] ^ int(kernels.mix(np.array([0], np.uint64))[0])
    step = lambda lane: int(kernels.mix(np.array([lane ^ start], np.uint64))[0])
    lane = lambda b: int.from_bytes(b, "little")
    rng, found = random.Random(seed), []
    letter = lambda: bytes(rng.choice(range(0x80, 0x100)) for _ in range(8))  # noqa: E731  any bytes but blanks, held as they are
    while len(found) < n:
        a, b, tail = letter(), letter(), letter()
        other = (lane(tail) ^ step(lane(a)) ^ step(lane(b))).to_bytes(8, "little")
        if not set(other) & {0x20, *range(9, 14)} and not any(65 <= c <= 90 for c in other):
            found.append((a + tail, b + other))
    return found


def test_words_made_to_collide():
    """The construction holds without a key, for one seed; the other seed and any key tell the words apart."""
    import numpy as np

    pairs = colliding_words(1, 40)

    def hashes(words_, key):
        data = np.frombuffer(b" ".join(words_) + b"\n", np.uint8)
        s, e, _ = kernels.words(data, np.array([0, len(data)]))
        assert len(s) == len(words_)
        return kernels.slice_hashes(data, s, e, (0, 1), key)

    a, b = hashes([p for p, _ in pairs], 0), hashes([q for _, q in pairs], 0)
    assert (a[0] == b[0]).all() and not (a[1] == b[1]).any()
    for key in (1, 2**63 + 5, kernels.fresh_key()):
        a, b = hashes([p for p, _ in pairs], key), hashes([q for _, q in pairs], key)
        assert not (a[0] == b[0]).any() and not (a[1] == b[1]).any()


def printable_collisions(n, seed=3):
    """Pairs of printable 16-byte words that collide for the first seed without a key."""
    import numpy as np

    rng = np.random.default_rng(seed)
    start = np.uint64(kernels._SEEDS[0]) ^ kernels.mix(np.array([0], np.uint64))[0]
    found = []
    while len(found) < n:
        # With second halves of one text each, first halves whose images differ by printable bytes only.
        raw = rng.integers(0x61, 0x7B, (1 << 16, 8)).astype(np.uint8)
        img = kernels.mix(raw.view("<u8")[:, 0] ^ start)
        order = np.argsort(img & np.uint64(0xE0E0E0E0E0E0E0E0))
        d = img[order][1:] ^ img[order][:-1]
        for i in np.flatnonzero((d & np.uint64(0xE0E0E0E0E0E0E0E0)) == 0).tolist():
            x = np.frombuffer(int(d[i]).to_bytes(8, "little"), np.uint8)
            tail = np.full(8, 0x61, np.uint8)
            other = tail ^ x
            if ((other > 0x20) & (other < 0x7F) & ~((other >= 65) & (other <= 90))).all():
                found.append((bytes(raw[order[i]]) + bytes(tail), bytes(raw[order[i + 1]]) + bytes(other)))
    return [(a.decode(), b.decode()) for a, b in found[:n]]


def test_texts_of_colliding_words_do_not_link(spark):
    """Two texts without a common word whose words collide pairwise under a known key: no link, nothing cut, ids and pieces right."""
    pairs = printable_collisions(24)
    texts = [" ".join(p[k] for p in pairs) for k in (0, 1)]
    assert not set(texts[0].split()) & set(texts[1].split())
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")
    known = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, key=0).collect()}
    assert known == {1: 1, 2: 1}  # this is what the construction does where the key is known
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == {1: (20, 1), 2: (20, 2)}
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs).collect()} == {1: 0, 2: 0}
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest() for i, t in enumerate(texts, 1)}
    assert {r.doc_id: r.ids_sha256 for r in bpe.digests(docs, path).collect()} == want
    from tokenizers import Tokenizer

    words_ = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(words_)
    pieces = {r.doc_id: r.ids_crc32 for r in packing.pack(docs, words_).collect()}
    crc = lambda t: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*tok.encode(t, add_special_tokens=False).ids, 0]))
    assert pieces == {i: crc(t) for i, t in enumerate(texts, 1)}


def thue_morse(n):
    """A string of a and b and its complement, which polynomial hashes modulo a power of two confuse."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]


def test_hashes_tell_thue_morse_strings_apart(spark):
    import pyarrow as pa

    for n in (64, 128, 256, 1024, 2048, 4096):
        pair = thue_morse(n)
        _, data, off = next(kernels.chunks(pa.array([*pair, pair[0]]), 1 << 30))
        s, e, _ = kernels.words(data, off)
        for h in kernels.slice_hashes(data, s, e, (0, 1)):
            assert h[0] == h[2] != h[1]
        first, back = kernels.distinct_slices(data, s, e)
        assert len(first) == 2 and back[0] == back[2] != back[1]
    a, b = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(19))
    rows = spark.createDataFrame([(1, f"{a} {rest}", "s"), (2, f"{b} {rest}", "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(rows).collect()} == {1: 0, 2: 0}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(rows).collect()}
    assert got == components_by_force([(1, f"{a} {rest}"), (2, f"{b} {rest}")])
    both = spark.createDataFrame([(0, thue_morse(2048)[0]), (1, thue_morse(2048)[1])], "doc_id long, text string").coalesce(1)
    enc = reference_encoding()
    ids = {r.doc_id: r.ids for r in bpe.encode(both, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert [ids[k] for k in (0, 1)] == [enc.encode_ordinary(t) for t in thue_morse(2048)]
    words_of_pack = packing.WordTokens(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    one, two = ([own[1][own[2][i] : own[2][i + 1]].tolist() for own in words_of_pack.encode(pa.array(thue_morse(2048))) for i in range(2)])
    assert one != two


def test_distinct_slices_where_hashes_collide(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(kernels, "slice_hash", lambda data, s, e, seed=0, key=0: (e - s).astype("uint64") // 4)
    texts = ["aa bb aa c", "dddd dddd eeee", "x" * 300 + " " + "x" * 299 + "y " + "x" * 300]
    _, data, off = next(kernels.chunks(pa.array(texts)))
    s, e, _ = kernels.words(data, off)
    first, back = kernels.distinct_slices(data, s, e)
    raw = data.tobytes()
    assert [raw[s[first[k]] : e[first[k]]] for k in back] == [raw[a:b] for a, b in zip(s, e, strict=True)] and len(first) == 7


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_by_force(rows, threshold=75):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), v in zip(sets, label, strict=True):
        least[v] = min(least.get(v, i), i)
    return {i: (len(s), least[v]) for (i, s), v in zip(sets, label, strict=True)}


def test_jaccard(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    want = components_by_force([(i, t) for i, t, *_ in corpus()])
    assert got == want and any(i != c for i, (_, c) in want.items())
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_jaccard_two_versions_two_footers(spark):
    """The versions link with each other and with their own mirrors only, which are the pivots."""
    core = [f"c{i}" for i in range(90)]
    versions = [core + [f"{v}{i}" for i in range(10)] for v in "xy"]
    feet = [[f"{v}foot{i}" for i in range(20)] for v in "xy"]
    sets = versions + [versions[v] + feet[v] + [f"m{v}at{k}"] for v in (0, 1) for k in range(8)]
    sets += [feet[v] + [f"o{v}at{k}at{i}" for i in range(30)] for v in (0, 1) for k in range(40)]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id int, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, shingle=1).collect()}
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(set(sets[i]) & set(sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    assert [got[i] for i in range(len(sets))] == want
    assert want[:18] == [0] * 18 and len(set(want)) == 81


def labels_by_force(sets, threshold=75):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return label


def test_cells_join_exactly(spark, monkeypatch):
    """Chains and loose copies that share one cell: it is parted by windows many times, and no link is lost."""
    import numpy as np

    monkeypatch.setattr(jaccard, "LEAF", 8)
    rng = random.Random(11)
    sets = [{5, *range(10_000 * c + j * (8 + 4 * c), 10_000 * c + j * (8 + 4 * c) + 90)} for c in range(5) for j in range(30)]
    core = [rng.randrange(1 << 40) for _ in range(90)]
    for _ in range(80):
        s = core.copy()
        for k in rng.sample(range(90), rng.randrange(25)):
            s[k] = rng.randrange(1 << 41, 1 << 42)
        sets.append({5, *s})
    sets += [{5, *range(500_000 + 100 * g + k, 500_000 + 100 * g + k + 20)} for g in range(30) for k in range(2)]
    packed = [np.sort(np.array(list(s), np.int64)).tobytes() for s in sets]
    rows = [(i, len(s), p, [5], rng.random()) for i, (s, p) in enumerate(zip(sets, packed, strict=True))]
    nodes = spark.createDataFrame(rows, "node long, n long, elems binary, sigs array<long>, score double")
    got = {r.node: r.label for r in jaccard.components_of_sets(nodes).collect()}
    want = labels_by_force(sets)
    assert len(set(zip(want, map(got.get, range(len(sets))), strict=True))) == len(set(want)) == len(set(got.values()))


def test_jaccard_chain_and_null_ids(spark):
    rng = random.Random(3)
    w = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(25):
        rows.append((100 - k, " ".join(w)))
        w = w[3:] + [f"z{rng.random()}" for _ in range(3)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "a b c d e f")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()]
    want = components_by_force(rows)
    assert {i: c for i, c in got if i is not None} == {i: c for i, (_, c) in want.items()}
    assert sorted((c or 0) for i, c in got if i is None) == [0, want[100][1]]


def test_rules(spark, docs):
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    for i, t, *_ in corpus():
        w, t = words(t), t or ""
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert rules.quality_rules(empty(spark)).count() == 0


def test_rules_cut_frequent_lines(spark):
    body = lambda k: " ".join(f"u{k}x{j}" for j in range(60))
    menu = " ".join(f"m{j}" for j in range(20))
    rows = [(k, f"{menu.upper()}\n{body(k)}", "h") for k in range(6)]
    rows += [(10, f"{menu}\n" * 30 + body(10), "h"), (11, f"{menu} \n{body(11)}", None), (11, f"{menu} \n{body(11)}", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: r for r in rules.quality_rules(df, small=(3, 0.1), large=(3, 0.1)).collect()}
    assert got[0].clean_text == body(0) and got[0].n_left == 60 and got[0].kept
    assert got[10].n_left == 60 and not got[10].kept
    assert got[11].clean_text == rows[-1][1] and got[11].kept
    assert rules.quality_rules(df).count() == len(rows)


def test_default_limits_reject_depleted_documents_of_small_and_hot_hosts(spark):
    """A menu of eight lines in most documents of a host goes; documents with little else are rejected."""
    menu = "\n".join(" ".join(f"m{i}word{j}" for j in range(12)) for i in range(8))
    body = lambda k, n: " ".join(f"u{k}x{j}" for j in range(n))
    rows = [(k, f"{menu}\n{body(k, 10 if k % 2 else 90)}", "small") for k in range(8)]
    rows += [(1000 + k, f"{menu}\n{body(k, 10 if k % 2 else 90)}" if k < 60 else body(k, 60), "hot") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: r for r in rules.judged(df).collect()}
    for i, t, host in rows:
        has_menu = "m0word0" in t
        n = len(words(t))
        left = n - 96 if has_menu else n
        assert (got[i].n_words, got[i].n_left, got[i].kept) == (n, left, left >= 0.2 * n), (i, host)
    assert not got[1].kept and got[0].kept and not got[1001].kept and got[1000].kept


def test_rules_tell_nulls_apart_and_texts_of_over_a_million_words(spark):
    rows = [(None, "x " * 60, "h"), (7, "x " * 60, None), (8, None, "h"), (9, " ".join(f"w{j}" for j in range(1_100_000)) + " w1 w2 w3", "h")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: r for r in rules.quality_rules(df.drop("_").withColumn("kept", F.lit("clash"))).collect()}
    assert len(got) == 4 and got[None].source == "h" and got[7].source is None and got[8].n_words == 0
    assert got[9].n_words == 1_100_003 and got[9].n_repeat_words == 6 and got[9].kept and got[8].base_failed


def test_shards(spark, docs):
    rows = sorted((i, t or "") for i, t, *_ in corpus())
    size = [len(t.encode()) + 1 for _, t in rows]
    run, slots, want = 0, Counter(), {}
    for (i, t), n in zip(rows, size, strict=True):
        s = min((2 * run + n) * 8 // (2 * sum(size)), 7)
        want[i] = (n, zlib.crc32(t.encode()), s, slots[s])
        slots[s] += 1
        run += n
    got = sharding.byte_shards(docs).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in got} == want
    assert sharding.byte_shards(empty(spark)).count() == 0
    same = spark.createDataFrame([(None, "x")] * 16, "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in sharding.byte_shards(same).collect()) == [(s, k) for s in range(8) for k in range(2)]


def reference_encoding():
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark):
    rng = random.Random(5)
    letters = "aab bc'sstrevelld  \n\t \u00a0\u3000é中文12½!?!!'''́🙂 "
    texts = [None, "", "'s", "don't we'll I'd''s", "  a", "a  ", "\n\na", " \t 9 ''ll", "!" * 3000, "ab" * 2000, "<|endoftext|>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    path, enc = public_tokenizers.path("byte_bpe_50k.tiktoken"), reference_encoding()
    encoded = bpe.encode(df, path)
    got = {r.doc_id or 0: r for r in bpe.decode(encoded, path).collect()}
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert got[i].ids == want and got[i].text == (t or "") and sum(got[i].slice_tokens) == len(want)
        ends = [*got[i].slice_offsets[1:], len((t or "").encode())][: len(got[i].slice_offsets)]
        assert all(a < b for a, b in zip(got[i].slice_offsets, ends, strict=True))
    short = {r.doc_id or 0: r for r in bpe.digests(df, path).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and short[i].n_tokens == len(ids)


def test_word_tokens_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(3)
    letters = "aAb B'sSllé́ \u0085\x1c中1½!?<|endoftext|>\u200d🙂İΣς\t\n Å"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|> a"]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts += ["a <|endoftext|>b", "<|startoftext|>", "x<|endoftext|><|endoftext|> y\nz", "<|ENDOFTEXT|>", "<|endoftext|"]
    own = packing.WordTokens(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    own.LIMIT = 200  # the cache shrinks many times
    got = []
    for a in range(0, len(texts), 100):
        for _, ids, off in own.encode(pa.array(texts[a : a + 100])):
            got += [ids[off[i] : off[i + 1]].tolist() for i in range(len(off) - 1)]
    assert got == [whole.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_plan_fits_and_is_tight():
    rng = random.Random(9)
    for trial in range(40):
        counts = Counter(rng.randint(1, rng.choice([20, 64])) for _ in range(rng.randint(0, 400)))
        bins: dict[int, list] = {}
        seen = Counter()
        for n, first, ranks, copies, start, offset in packing.plan(counts, 64):
            assert first == seen[n]
            seen[n] += ranks
            for k in range(ranks):
                bins.setdefault(start + k // copies, []).append((offset + k % copies * n, n))
        assert seen == counts
        for v in bins.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= 64
        total = sum(n * c for n, c in counts.items())
        assert len(bins) <= -(-total // 64) * 1.25 + 1
    assert packing._best_two([3, 5, 6, 9], {3: 1, 5: 1, 6: 1, 9: 1}, 11, 9) == (6, 5)
    assert packing._best_two([5], {5: 1}, 11, 9) is None


def best_two_fit_by_bin(counts, capacity):
    """Bins one by one: the longest piece that fits, over and over; then the smallest makes way for the best pair."""
    left, bins = Counter(counts), []
    while +left:
        own, gap = [], capacity
        while fit := [n for n in left if left[n] and n <= gap]:
            n = max(fit)
            own.append(n)
            left[n] -= 1
            gap -= n
        if gap:
            small = min(own)
            own.remove(small)
            left[small] += 1
            free = Counter(left)
            free[small] -= 1
            pairs = [(a + b, -a, a, b) for a in free for b in free if a >= b and free[a] and free[b] and (a != b or free[a] > 1) and small < a + b <= gap + small]
            take = max(pairs)[2:] if pairs else (small,)  # of equal sums the more even pair
            own += take
            for n in take:
                left[n] -= 1
        bins.append(sorted(own))
    return bins


def test_plan_is_best_two_fit_bin_by_bin():
    rng = random.Random(12)
    for trial in range(60):
        top = rng.choice([12, 20, 40, 64])
        counts = Counter(rng.randint(1, top) for _ in range(rng.randint(0, 300)))
        bins: dict[int, list] = {}
        for n, _, ranks, copies, start, _ in packing.plan(counts, 64):
            for k in range(ranks):
                bins.setdefault(start + k // copies, []).append(n)
        want = best_two_fit_by_bin(counts, 64)
        total = sum(n * c for n, c in counts.items())
        assert len(bins) == len(want) and sorted(sorted(b) for b in bins.values()) == sorted(want), trial
        assert len(bins) <= -(-total // 64) * 1.1 + 1


def test_pack(spark, docs):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    assert {r.doc_id for r in got} == {i for i, *_ in corpus()}
    bins: dict[int, list] = {}
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in bins.values():
        assert [o for o, _ in sorted(v)] == [sum(n for p, n in v if p < o) for o, _ in sorted(v)] and sum(n for _, n in v) <= 2048
    assert packing.pack(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_quality_learns_and_never_reads_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        w = [rng.choice("the of and river stone walked slowly under morning light".split()) for _ in range(60)]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "x", i, "n", "s"))
        labels.append((i, int(good)))
    rows += [(1000, None, None, 0, "n", "s"), (1001, "", None, 0, "n", "s"), (None, "x y", None, 0, "n", "s"), (1, rows[1][1], "x", 1, "n", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.learn(df, known)
    got = quality.classify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    flipped = known.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn(df, flipped) == model
    assert quality.classify(empty(spark), quality.learn(empty(spark), known)).count() == 0


def test_fit_is_the_bradley_terry_maximum():
    """The weights minimise the pairs' mean logistic loss: an independent descent ends at the same loss and weights."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 300
    x = rng.normal(size=(n, len(quality.FEATURES)))
    y = (x @ rng.normal(size=x.shape[1]) + rng.normal(size=n) * 3 > 0.5).astype(int)
    pairs = 4000
    model = quality.fit(x, y, pairs, seed=5)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -quality.CLIP, quality.CLIP)
    b = np.concatenate([z, z * z], 1)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = b[np.random.default_rng(5).choice(good, pairs)] - b[bad[np.arange(pairs) % len(bad)]]
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + quality.L2 / 2 * w @ w
    w, step = np.zeros(d.shape[1]), 0.05
    for _ in range(6000):  # plain gradient descent
        w = w - step * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + quality.L2 * w)
    assert abs(loss(np.array(model["w"])) - loss(w)) < 1e-4
    s = quality.score(model, x)
    assert np.corrcoef(np.log(s / (1 - s)), b @ w)[0, 1] > 0.999
    assert abs((s < quality.CUT).sum() - len(bad)) <= 1  # the cut is the quantile at the share of quality 0
    assert ((s[good][:, None] > s[bad][None]).mean()) > 0.75


def test_learning_takes_one_row_of_a_repeated_id(spark):
    rows = [(1, "a b c", 1), (1, "a b c d e", 1), (1, "a b c", 1), (2, "X! Y!", 0)] * 30
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    once = spark.createDataFrame([(1, "a b c"), (2, "X! Y!")], "doc_id long, text string")
    assert quality.learn(df, labels) == quality.learn(once, labels)


def test_one_very_long_text(spark):
    """A text far over the chunk size, with an equal half, an empty text and nulls beside it."""
    half = " ".join(f"w{i}é" for i in range(200_000))
    rows = [(1, half + "\n" + half), (2, ""), (3, None), (None, half[:1000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash"))
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup_substrings(df).collect()}
    n = len(half[:1000].split())
    assert cut[1] == (400_000, 200_000) and cut[2] == cut[3] == (0, 0)
    assert cut[None] in ((n, n), (n, n - 1))  # its last word is cut short
    ids = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.digests(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert ids[1] == (len(reference_encoding().encode_ordinary(rows[0][1])), hashlib.sha256(rows[0][1].encode()).hexdigest())
    packed = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).where("doc_id = 1").orderBy("piece").collect()
    assert [r.length for r in packed[:-1]] == [2048] * (len(packed) - 1) and [r.start for r in packed] == [2048 * k for k in range(len(packed))]


def test_kernels_words():
    import pyarrow as pa

    texts = ["a  b\tcé", None, "", "\x0b", "x" * 5000 + " y"]
    out = []
    for _, data, off in kernels.chunks(pa.array(texts), 100):
        s, e, fw = kernels.words(data, off)
        raw = data.tobytes()
        out += [[raw[s[k] : e[k]].decode() for k in range(fw[i], fw[i + 1])] for i in range(len(off) - 1)]
    assert out == [words(t) for t in texts]


def test_word_tokens_with_the_word_between():
    """Texts that hold the word which parts a call's words, white space beyond ASCII and marks at edges: ids as the library gives them."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        own = packing.WordTokens(f.read())
    word, token = own.between
    rng = random.Random(6)
    parts = ["a", "B", "é", "J\u030c", "\u0301x", ".", "'s", "9", " ", "\n", "\u3000", word, f" {word} ", word.upper(), "<|endoftext|>", "\u00df", "\u03a3"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, ""]
    got = [ids[a:b].tolist() for _, ids, off in own.encode(pa.array(texts)) for a, b in zip(off, off[1:], strict=False)]
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == [[*e.ids, packing.END_ID] for e in want] and any(token in g for g in got)

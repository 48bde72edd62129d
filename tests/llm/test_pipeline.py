"""Each stage of the pipeline on what the one before kept, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paperloom.llm import quality

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus():
    """Clean and shouting texts, menus, near and exact copies, a shared passage, nulls, empty texts and repeated rows."""
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(900)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    menu, passage = "\n".join(make(9) for _ in range(6)), make(60)
    rows = []
    for k in range(60):
        text = make(80)
        if k % 6 == 0:
            text = f"{menu}\n{text}" if k % 12 else f"{menu}\n{make(6)}"
        if k % 7 == 0:
            text += "\n" + passage
        if k % 5 == 0:
            text = " ".join(w.upper() + "!!!" for w in text.split())
        rows.append((k, text, "a" if k % 2 else None))
    for k in range(8):
        w = rows[1][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w), "b"))
    rows += [(200, rows[2][1], "b"), (2, rows[2][1], "b"), (None, rows[3][1], "a"), (None, make(90), "a"), (300, None, "a"), (301, "", "a"), (302, " \n ", None), (3, make(70), "a")]
    return [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]


def rule_kept(rows):
    lines = lambda t: {" ".join(x.lower().split()) for x in (t or "").split("\n") if words(x)}
    held, hosts = Counter(), Counter()
    for _, t, _, s, _ in rows:
        hosts[s] += 1
        held.update((s, x) for x in lines(t))
    out = []
    for i, t, lang, s, _ in rows:
        most = min(max(5, hosts[s] * 0.1), max(50, hosts[s] * 0.01), 1000)
        w = words(t)
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        if len(w) < 50 or 100 * len(cover) > 50 * len(w):
            continue
        left = "\n".join(x for x in t.split("\n") if held[s, " ".join(x.lower().split())] <= most)
        if len(words(left)) >= 0.2 * len(w):
            out.append((i, left, lang, s, len(left)))
    return out


def one_of_each(rows):
    grams = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} if (w := words((r[1] or "").lower())) else set() for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if grams[a] and grams[b] and 100 * len(grams[a] & grams[b]) >= 75 * len(grams[a] | grams[b]):
                label = [label[b] if v == label[a] else v for v in label]
    groups: dict = {}
    for r, v in zip(rows, label, strict=True):
        groups.setdefault(v, []).append(r)
    return groups.values()


def cut(rows):
    """Kept words of rows in id order."""
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w, gone = words(t), set()
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            gone |= set(range(j, j + 20)) if key in seen else set()
            seen.add(key)
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each one."""
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(str(root / "documents.parquet"))
    labels = [(k, int(k % 5 != 0), 0) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    docs, out = spark.read.parquet(str(root / "documents.parquet")), {"documents": corpus()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(root)).write.parquet(str(root / name))
        before, docs = docs, spark.read.parquet(str(root / name))
        assert name == "best_fit_packing" or docs.columns == before.columns
        out[name] = [tuple(r) for r in docs.collect()]
    return out, str(root)


def test_rules_stage(stages):
    rows, _ = stages
    assert sorted(rows["quality_rules"], key=str) == sorted(rule_kept(rows["documents"]), key=str)
    kept = {r[0]: r[1] for r in rows["quality_rules"]}
    assert not {12, 24} & set(kept) and any(kept[i] != t for i, t, *_ in rows["documents"] if i in kept and i not in (2, 3, None))


def test_classifier_stage(spark, stages):
    rows, root = stages
    before = spark.createDataFrame(rows["quality_rules"], SCHEMA)
    model = quality.learn(before, spark.read.parquet(f"{root}/labels.parquet"))
    scored = quality.classify(before, model)
    assert sorted(map(str, rows["quality_classifier"])) == sorted(str(tuple(r)) for r in scored.where(F.col("score") >= 0.7).select(before.columns).collect())
    kept = {r[0] for r in rows["quality_classifier"]}
    assert not kept & {k for k in range(0, 60, 5)} and len(kept & {k for k in range(60) if k % 5}) >= 0.8 * len({r[0] for r in rows["quality_rules"] if r[0] is not None and r[0] < 60 and r[0] % 5})


def test_near_duplicates_stage(stages):
    rows, _ = stages
    groups = list(one_of_each(rows["quality_classifier"]))
    assert len(rows["near_duplicates"]) == len(groups) < len(rows["quality_classifier"])
    left = Counter(rows["near_duplicates"])
    for g in groups:
        ids = [r[0] for r in g if r[0] is not None]
        kept = [r for r in set(g) if left[r]]
        assert len(kept) == 1 and kept[0][0] == (min(ids) if ids else None)


def test_substring_stage(stages):
    rows, _ = stages
    by_id = Counter(r[0] for r in rows["near_duplicates"])
    want = cut([r for r in rows["near_duplicates"]])
    got = {r[0]: r[1] for r in rows["substring_dedup"]}
    assert {i: t for i, t in got.items() if by_id[i] == 1} == {i: t for i, t in want.items() if by_id[i] == 1}
    assert len(rows["substring_dedup"]) == len(rows["near_duplicates"]) and any(len(words(r[1])) > len(got[r[0]].split()) for r in rows["near_duplicates"])
    assert all(r[4] == len(r[1]) for r in rows["substring_dedup"])


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    rows, _ = stages
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows["substring_dedup"])
    assert Counter(r[3] for r in rows["best_fit_packing"]) == want  # none is over the capacity
    bins: dict = {}
    for r in rows["best_fit_packing"]:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(n * c for n, c in want.items())
    assert len(bins) <= -(-total // 2048) + 1


def test_stages_take_an_empty_table(spark, stages):
    _, root = stages
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
        assert docs.count() == 0, name


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, text(1)), (4, text(1)), (4, text(1)), (9, text(1)), (None, text(2)), (None, text(2)), (4, text(3)), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()]
    want = [(4, text(1)), (None, text(2)), (4, text(3)), (6, ""), (6, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()

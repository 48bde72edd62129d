from __future__ import annotations

import random

from paperloom.operators import generate as G


def by_rule(weights, total):
    """Marks by the published rule, one step at a time."""
    raw = [max(total * w / sum(weights), 1.0) for w in weights]
    marks = [int(x) for x in raw]
    order = sorted(range(len(raw)), key=lambda i: (-(raw[i] - int(raw[i])), i))
    rest, k = total - sum(marks), 0
    while rest:
        i = order[k % len(order)]
        if rest > 0:
            marks[i] += 1
            rest -= 1
        elif marks[i] > 1:
            marks[i] -= 1
            rest += 1
        k += 1
    return marks


def test_apportion(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for p in range(60):
        n = rng.randint(1, 8)
        w = [rng.choice([0.01, 0.5, 1.0, 3.0, 40.0]) for _ in range(n)]
        total = rng.randint(n, 30)
        want[p] = by_rule(w, total)
        rows += [(p, i, x, total) for i, x in enumerate(w)]
    rows.append((99, 0, 1.0, 0))
    df = spark.createDataFrame(rows, "p int, i int, w double, total int")
    got: dict = {}
    for r in G.apportion(df, "p", "i", "w", "total").orderBy("p", "i").collect():
        got.setdefault(r.p, []).append(r.marks)
    assert got.pop(99) == [None]
    assert got == want


def test_weights_add_up_in_index_order(spark):
    """The last bit of the weights' sum decides between equal fractions, so it must not hang on the order of the rows."""
    cases = {1: ([4.0, 1.7, 1.6, 2.3], 92, [38, 16, 16, 22]), 2: ([0.4, 2.8, 1.0, 2.3], 35, [2, 15, 5, 13]), 3: ([0.5, 3.3, 4.6, 1.1, 0.3], 84, [4, 28, 40, 9, 3])}
    rows = [(p, i, x, total) for p, (w, total, _) in cases.items() for i, x in enumerate(w)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "p int, i int, w double, total int").coalesce(1)
        got = {(r.p, r.i): r.marks for r in G.apportion(df, "p", "i", "w", "total").collect()}
        assert got == {(p, i): m for p, (_, _, marks) in cases.items() for i, m in enumerate(marks)}


def test_difficulty_targets():
    assert G.difficulty_targets(0.5, 7) == {"easy": 0, "medium": 7, "hard": 0}
    assert G.difficulty_targets(0.25, 5) == {"easy": 3, "medium": 2, "hard": 0}
    for c in range(11):
        for n in range(12):
            assert sum(G.difficulty_targets(c / 10, n).values()) == n


def bank(spark, rows):
    return spark.createDataFrame(rows, "id long, type string, difficulty string, subjects array<string>, tags array<string>, weight double")


def test_generate_meets_quotas_and_ignores_order(spark):
    rng = random.Random(1)
    rows = [
        (i, rng.choice(["single_choice", "essay"]), rng.choice(["easy", "medium", "hard"]), ["Math"], [rng.choice("abcdef")], rng.choice([1.0, 2.0]))
        for i in range(80)
    ]
    r = G.Request(5, 10, 0.5, (("single_choice", 3), ("essay", 2)), (" math",), ("a",), ("b",), 42, 16, 8)
    first = {(x.id, x.item_order, x.fitness) for x in G.generate(bank(spark, rows), [r]).collect()}
    rng.shuffle(rows)
    assert first == {(x.id, x.item_order, x.fitness) for x in G.generate(bank(spark, rows), [r]).collect()}
    kinds = {i: t for i, t, *_ in rows}
    assert sorted(kinds[i] for i, _, _ in first) == ["essay"] * 2 + ["single_choice"] * 3
    short = G.Request(6, 200, 0.5, (("blank", 1),), ("math",))
    assert G.generate(bank(spark, rows), [short]).count() == 0


def test_generate_sees_every_candidate(spark):
    """One question of many has the required tag, the wanted difficulty and weight."""
    rows = [(i, "essay", "hard", ["Math"], ["b", "a"][:: 1 - 2 * (i % 2)], 1.0) for i in range(20_000)]
    rows[777] = (777, "essay", "easy", ["math"], [" Rare"], 9.0)
    r = G.Request(7, 10, 0.0, (("essay", 2),), ("math",), ("rare",), (), 3, 40, 30)
    assert 777 in {x.id for x in G.generate(bank(spark, rows), [r]).collect()}


def test_requests_are_checked():
    assert G.Request(1, 1, 2.0, (("x", 3),), ()).errors()


def test_fitness_by_force(spark):
    rng = random.Random(6)
    pool = [(1, n, rng.choice(["single_choice", "essay"]), rng.choice(["easy", "medium", "hard"]), rng.sample(["a", "b", "c", "d"], 2), [rng.choice("xyz")], rng.choice([0.5, 2.0])) for n in range(30)]
    people = [(1, p, rng.sample(range(30), 5)) for p in range(25)]
    run = [(1, 7.0, 0, ["a", "q"], ["b", "c"], {"single_choice": 3, "essay": 2}, {"easy": 1, "medium": 3, "hard": 1})]
    got = G.fitness(
        spark.createDataFrame(people, G.PERSON),
        spark.createDataFrame(pool, "request_id int, n int, type string, difficulty string, tags array<string>, subjects array<string>, weight double"),
        spark.createDataFrame(run, "request_id int, total_marks double, seed long, required array<string>, preferred array<string>, quotas map<string,int>, difficulties map<string,int>"),
    ).collect()
    want = {}
    for _, p, genes in people:
        rows = [pool[n] for n in genes]
        tags, subjects = {t for r in rows for t in r[4]}, {t for r in rows for t in r[5]}
        gap = lambda k, goal: sum(abs(sum(r[k] == v for r in rows) - n) for v, n in goal.items())
        want[p] = (
            1000 - 40 * gap(3, run[0][6]) - 30 * gap(2, run[0][5]) - 80 * len({"a", "q"} - tags) - 8 * abs(sum(r[6] for r in rows) - 7)
            + 24 * len({"b", "c"} & tags) + 2 * min(len(tags), 10) + 3 * min(len(subjects), 3)
        )
    assert {r.person: r.fitness for r in got} == want


def test_people_stay_sets_of_their_types(spark):
    """Children keep a slot's type and hold no question twice; the elite come first and unchanged."""
    starts, sizes = [0, 0, 0, 4, 4], [4, 4, 4, 2, 2]
    plan, names = (1, 9, 12, 2, 3, 0.5, starts, sizes), "request_id int, seed long, population int, elite int, tournament int, mutation double, starts array<int>, sizes array<int>"
    people = G.first_people(spark.createDataFrame([plan], names)).collect()
    for generation in range(4):
        assert len(people) == 12
        for p in people:
            assert len(set(p.genes)) == 5 and all(s <= g < s + n for g, s, n in zip(p.genes, starts, sizes, strict=True))
        run = spark.createDataFrame([(*plan, generation, [p.genes for p in people])], f"{names}, generation int, people array<array<int>>")
        after = sorted(G.next_people(run).collect(), key=lambda r: r.person)
        assert [r.genes for r in after[:2]] == [p.genes for p in people[:2]]
        people = after
    assert len({tuple(p.genes) for p in people}) > 2

"""Paper generation: feasibility, an evolutionary search as DataFrame steps, marks by largest remainders.

A person is a question set: an array of candidate numbers, a slot for each
requested question.  Candidates of a type have a run of numbers, so a slot's
type is fixed, and crossover, mutation and repair are array expressions;
fitness is a join and an aggregate.  Randomness is a hash of seed, generation,
person and slot, so that results depend on neither row order nor partitions.
A generation is one job over all requests; what the driver holds between two
is the population, whose size the request states.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DIFFICULTIES, QUESTION_TYPES

def difficulty_targets(coefficient: float, count: int) -> dict[str, int]:
    """Questions of each difficulty: triangular weights around the coefficient, rounded half up.

    A wrong sum is mended on the largest count, the hardest of equals.
    """
    c = min(max(coefficient, 0.0), 1.0)
    weights = [max(0.0, 1 - abs(c - anchor) * 2) for anchor in (0.0, 0.5, 1.0)]
    counts = [int(count * w / sum(weights) + 0.5) for w in weights]
    while sum(counts) != count:
        k = max(range(3), key=lambda i: (counts[i], i))
        counts[k] += 1 if sum(counts) < count else -1
    return dict(zip(DIFFICULTIES, counts, strict=True))


@dataclass(frozen=True)
class Request:
    """What a paper needs: types is (question type, count) pairs."""

    request_id: int
    total_marks: int
    coefficient: float
    types: tuple[tuple[str, int], ...]
    subjects: tuple[str, ...]
    required_tags: tuple[str, ...] = ()
    preferred_tags: tuple[str, ...] = ()
    seed: int = 0
    population: int = 80
    generations: int = 120
    elite: int = 4
    tournament: int = 3
    mutation: float = 0.08

    def errors(self) -> list[str]:
        n = sum(c for _, c in self.types)
        checks = [
            (n < 1, "at least one question is required"),
            (any(c < 0 for _, c in self.types), "counts must not be negative"),
            (any(t not in QUESTION_TYPES for t, _ in self.types), "unknown question type"),
            (self.total_marks < n, "total marks must be at least the question count"),
            (not self.subjects, "subjects is required"),
            (not 0 <= self.coefficient <= 1, "difficulty must be between 0 and 1"),
            (not 1 <= self.elite < self.population, "elite must be smaller than the population"),
        ]
        return [text for bad, text in checks if bad]

    def quotas(self) -> dict[str, int]:
        total: Counter = Counter()
        for kind, count in self.types:
            total[kind] += count
        return {k: total[k] for k in QUESTION_TYPES if total[k]}


def normal(col: Column) -> Column:
    return F.lower(F.trim(col))


def candidates(bank: DataFrame, request: Request) -> DataFrame:
    """Questions of a requested type that share a subject, in any case."""
    subjects = F.array(*[F.lit(s.strip().lower()) for s in request.subjects])
    return bank.where(
        F.col("type").isin(*request.quotas()) & F.arrays_overlap(F.transform("subjects", normal), subjects)
    )


def shortages(bank: DataFrame, quotas: DataFrame) -> DataFrame:
    """(type, requested, available, short) of types with fewer questions than asked; quotas is (type, requested)."""
    have = bank.groupBy("type").agg(F.count("*").alias("available"))
    joined = quotas.join(have, "type", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return joined.where("available < requested").withColumn("short", F.col("requested") - F.col("available"))


def missing_tags(bank: DataFrame, required: list[str]) -> DataFrame:
    """(tag) required ones that no question has."""
    spark = bank.sparkSession
    want = spark.createDataFrame([(t.strip().lower(),) for t in required], "tag string").distinct()
    return want.join(bank.select(F.explode(F.transform("tags", normal)).alias("tag")).distinct(), "tag", "left_anti")


PERSON = "request_id int, person int, genes array<int>"


def _unit(*parts) -> Column:
    """A number from 0 up to 1 by the hash of its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _draw(n: Column, *parts) -> Column:
    return F.pmod(F.xxhash64(*parts), n).cast("int")


def _tokens(col: str) -> Column:
    return F.array_distinct(F.transform(col, normal))


def fitness(people: DataFrame, pool: DataFrame, requests: DataFrame) -> DataFrame:
    """people with fitness: 1000 less 40, 30, 80 and 8 for gaps of difficulty, type, required tags and weight, plus 24 a
    preferred tag, 2 a tag (10 at most) and 3 a subject (3 at most).

    pool: request_id, n (a candidate's number), type, difficulty, tags,
    subjects, weight.  A gap of types, difficulties or weight is the absolute
    difference from what the request states.
    """
    genes = people.select("request_id", "person", "genes", F.explode("genes").alias("n"))
    of = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    counts = [F.count_if(F.col(c) == v).alias(v) for c, vs in (("difficulty", DIFFICULTIES), ("type", QUESTION_TYPES)) for v in vs]
    # The people of a request are as many as it states; the pool is not sent anywhere.
    sums = F.broadcast(genes).join(pool, ["request_id", "n"]).groupBy("request_id", "person", "genes").agg(of("tags"), of("subjects"), F.sum("weight").alias("weight"), *counts)
    gap = lambda vs, want: sum((F.abs(F.col(v) - F.coalesce(F.col(want)[v], F.lit(0))) for v in vs), F.lit(0))
    score = (
        1000
        - 40 * gap(DIFFICULTIES, "difficulties")
        - 30 * gap(QUESTION_TYPES, "quotas")
        - 80 * F.size(F.array_except("required", "tags"))
        - 8 * F.abs(F.col("weight") - F.col("total_marks"))
        + 24 * F.size(F.array_intersect("preferred", "tags"))
        + 2 * F.least(F.size("tags"), F.lit(10))
        + 3 * F.least(F.size("subjects"), F.lit(3))
    )
    return sums.join(F.broadcast(requests), "request_id").select("request_id", "person", "genes", score.cast("double").alias("fitness"))


def ranked(scored: DataFrame) -> DataFrame:
    """The people of each request by place from 0: the fittest first, then the lesser numbers."""
    w = Window.partitionBy("request_id").orderBy(F.desc("fitness"), F.array_sort("genes"), "genes")
    return scored.withColumn("place", F.row_number().over(w) - 1)


def _repaired(genes: Column, starts: Column, sizes: Column) -> Column:
    """Genes without repeats: one that an earlier slot has goes on to the next free number of its type."""

    def step(done: Column, gene: Column) -> Column:
        slot = F.size(done) + 1
        start, size = F.element_at(starts, slot), F.element_at(sizes, slot)
        ring = F.transform(F.sequence(F.lit(0), F.least(F.size(done), size - 1)), lambda k: start + F.pmod(gene - start + k, size))
        return F.concat(done, F.slice(F.filter(ring, lambda x: ~F.array_contains(done, x)), 1, 1))

    return F.aggregate(genes, F.array().cast("array<int>"), step)


def first_people(requests: DataFrame) -> DataFrame:
    """The first population: every slot takes a number of its type by hash."""
    person = F.explode(F.sequence(F.lit(0), F.col("population") - 1)).alias("person")
    rows = requests.select("request_id", "seed", "starts", "sizes", person)
    genes = F.transform("starts", lambda start, k: start + _draw(F.element_at("sizes", k + 1), F.col("seed"), F.lit(-1), F.col("person"), k))
    return rows.select("request_id", "person", _repaired(genes, F.col("starts"), F.col("sizes")).alias("genes"))


def next_people(requests: DataFrame) -> DataFrame:
    """The elite as they are, and children: parents by tournament, a prefix of one with the rest of the other, mutations, repair.

    requests has generation, a number, and people, the genes of the population by place.
    """
    elite = requests.select("request_id", F.posexplode(F.slice("people", F.lit(1), F.col("elite"))).alias("person", "genes"))
    person = F.explode(F.sequence(F.col("elite"), F.col("population") - 1)).alias("person")
    child = requests.select("request_id", "seed", "starts", "sizes", "population", "tournament", "mutation", "generation", "people", person)
    at = (F.col("seed"), F.col("generation"), F.col("person"))
    # Places are in order of fitness, so the best of those drawn is the least.
    best = lambda side: F.array_min(F.transform(F.sequence(F.lit(1), F.col("tournament")), lambda k: _draw(F.col("population"), *at, F.lit(side), k)))
    parents = child.select("*", F.element_at("people", best(1) + 1).alias("a"), F.element_at("people", best(2) + 1).alias("b")).drop("people")
    slots = F.size("a")
    cut = F.when(slots > 1, _draw(slots - 1, *at, F.lit(3)) + 1).otherwise(1)
    mixed = F.concat(F.slice("a", F.lit(1), cut), F.slice("b", cut + 1, slots))

    def mutated(gene: Column, k: Column) -> Column:
        new = F.element_at("starts", k + 1) + _draw(F.element_at("sizes", k + 1), *at, F.lit(5), k)
        return F.when(_unit(*at, F.lit(4), k) < F.col("mutation"), new).otherwise(gene)

    genes = _repaired(F.transform("mixed", mutated), F.col("starts"), F.col("sizes"))
    return elite.union(parents.withColumn("mixed", mixed).select("request_id", "person", genes.alias("genes")))


def generate(bank: DataFrame, requests: list[Request]) -> DataFrame:
    """(request_id, id, item_order, fitness) of the question sets found; requests that cannot be met give no rows.

    bank: id long, type, difficulty, subjects array, tags array, weight
    double.  Fitness knows a question by its type, difficulty, weight, tags and
    subjects only, so of questions that are equal in these a search gets as many
    as the type's quota, the first by a hash of seed and id, and no others are
    left out: what it can reach is what all candidates can reach.  A search
    ends after its generations, or from the 51st on after 30 without a better
    set.  The result does not depend on row order.
    """
    spark = bank.sparkSession
    for r in requests:
        if r.errors():
            raise ValueError(f"request {r.request_id}: {'; '.join(r.errors())}")
    parts = None
    for r in requests:
        rows = candidates(bank, r).select(
            F.lit(r.request_id).alias("request_id"), "id", "type", "difficulty", _tokens("subjects").alias("subjects"), _tokens("tags").alias("tags"),
            F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.01)).alias("weight"), F.xxhash64(F.lit(r.seed), "id").alias("_h"),
        )
        parts = rows if parts is None else parts.union(rows)
    kind = Window.partitionBy("request_id", "type", "difficulty", "weight", F.array_sort("tags"), F.array_sort("subjects")).orderBy("_h", "id")
    quota = spark.createDataFrame(
        [(r.request_id, t, n) for r in requests for t, n in r.quotas().items()], "request_id int, type string, _quota int"
    )
    kept = parts.withColumn("_n", F.row_number().over(kind)).join(F.broadcast(quota), ["request_id", "type"]).where("_n <= _quota")
    order = Window.partitionBy("request_id", "type").orderBy("id")
    pool = kept.withColumn("_at", (F.row_number().over(order) - 1).cast("int")).drop("_n", "_h", "_quota").persist()
    have = {(r["request_id"], r["type"]): r["count"] for r in pool.groupBy("request_id", "type").count().collect()}  # a number for each type
    plans, firsts = [], []
    for r in requests:
        quotas = r.quotas()
        if any(have.get((r.request_id, t), 0) < n for t, n in quotas.items()):
            continue
        starts, sizes, start = [], [], 0
        for t, n in quotas.items():
            size = have[r.request_id, t]
            starts, sizes = starts + [start] * n, sizes + [size] * n
            firsts.append((r.request_id, t, start))
            start += size
        clean = lambda tags: sorted({t.strip().lower() for t in tags})
        plans.append((
            r.request_id, float(r.total_marks), r.seed, r.population, r.elite, r.tournament, r.mutation, starts, sizes,
            clean(r.required_tags), clean(r.preferred_tags), quotas, difficulty_targets(r.coefficient, len(starts)),
        ))
    schema = (
        "request_id int, total_marks double, seed long, population int, elite int, tournament int, mutation double, starts array<int>, sizes array<int>, "
        "required array<string>, preferred array<string>, quotas map<string,int>, difficulties map<string,int>"
    )
    run = spark.createDataFrame(plans, schema)
    first = spark.createDataFrame(firsts, "request_id int, type string, _start int")
    numbered = pool.join(F.broadcast(first), ["request_id", "type"]).withColumn("n", F.col("_at") + F.col("_start")).drop("_at", "_start").persist()
    limit = {r.request_id: r.generations for r in requests}
    best: dict[int, tuple[float, int]] = {}
    placed = ranked(fitness(first_people(run), numbered, run))
    done: dict[int, list] = {}
    for generation in range(1 + max(limit.values(), default=0)):
        people = placed.collect() if plans else []  # the stated population of each request
        for r in people:
            if r["place"] == 0:
                value, since = best.get(r["request_id"], (float("-inf"), 0))
                best[r["request_id"]] = (r["fitness"], 0) if r["fitness"] > value else (value, since + 1)
        over = {k for k, (_, stale) in best.items() if k not in done and (generation >= limit[k] or (stale >= 30 and generation > 50))}
        for r in people:
            if r["request_id"] in over and r["place"] == 0:
                done[r["request_id"]] = [r]
        people = [r for r in people if r["request_id"] not in done]
        if not people:
            break
        own = {r["request_id"]: [] for r in people}
        for r in sorted(people, key=lambda r: r["place"]):
            own[r["request_id"]].append(r["genes"])
        # The generation is data, so that every generation runs the same compiled code.
        state = spark.createDataFrame([(*p, generation, own[p[0]]) for p in plans if p[0] in own], f"{schema}, generation int, people array<array<int>>")
        placed = ranked(fitness(next_people(state), numbered, state.drop("people", "generation")))
    found = spark.createDataFrame([(r["request_id"], r["genes"], r["fitness"]) for rs in done.values() for r in rs], "request_id int, genes array<int>, fitness double")
    chosen = found.select("request_id", "fitness", F.posexplode("genes").alias("item_order", "n"))
    return chosen.join(numbered, ["request_id", "n"]).select(F.col("request_id").cast("long").alias("request_id"), "id", "item_order", "fitness")


def apportion(items: DataFrame, key: str, index: str, weight: str, total: str) -> DataFrame:
    """Whole marks by weight: shares of at least 1, floored, then one more or less by largest fraction, then index.

    Groups with fewer marks than items get null.  What is left after the first
    round is dealt on in the same order, and nothing falls below 1: with more
    to take than there are items over 1 in a round, rounds go on.
    """
    group = Window.partitionBy(key)
    w = F.greatest(F.coalesce(F.col(weight), F.lit(1.0)), F.lit(0.01))
    out = items.withColumn("_w", w)
    whole = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # doubles add up in index order
    out = out.withColumn("_raw", F.greatest(F.col(total) * F.col("_w") / F.sum("_w").over(whole), F.lit(1.0)))
    out = out.withColumn("_floor", F.floor("_raw"))
    out = out.withColumn("_left", F.col(total) - F.sum("_floor").over(group)).withColumn("_n", F.count("*").over(group))
    order = Window.partitionBy(key).orderBy(F.desc(F.col("_raw") - F.col("_floor")), index)
    out = out.withColumn("_rank", F.row_number().over(order) - 1)
    more = F.floor(F.col("_left") / F.col("_n")) + (F.col("_rank") < F.col("_left") % F.col("_n")).cast("int")
    # Taking back: a round takes one from each item still over 1.  Whole rounds reach the level at which items are
    # used up one after another; the last, broken one takes from those above the level, in rank order.
    need = -F.col("_left")
    out = out.withColumn("_spare", F.col("_floor") - 1)
    up = Window.partitionBy(key).orderBy("_spare", index)
    below = F.sum("_spare").over(up.rowsBetween(Window.unboundedPreceding, 0))
    rest = F.col("_n") - F.row_number().over(up)
    out = out.withColumns({"_rest": rest, "_used": below + rest * F.col("_spare")})
    fits = (F.col("_left") < 0) & (F.col("_used") <= need)
    at = F.max(F.when(fits, F.struct("_spare", F.col("_used").alias("u"), (-F.col("_rest")).alias("r")))).over(group)
    out = out.withColumn("_at", F.coalesce(at, F.struct(F.lit(0).cast("bigint").alias("_spare"), F.lit(0).cast("bigint").alias("u"), (-F.col("_n")).alias("r"))))
    above = -F.col("_at.r")
    level = F.col("_at._spare") + F.when(above > 0, F.floor((need - F.col("_at.u")) / above)).otherwise(0)
    out = out.withColumn("_level", level)
    out = out.withColumn("_broken", need - F.sum(F.least("_spare", "_level")).over(group))
    turn = F.sum((F.col("_spare") > F.col("_level")).cast("int")).over(Window.partitionBy(key).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    taken = F.least("_spare", "_level") + ((F.col("_spare") > F.col("_level")) & (turn <= F.col("_broken"))).cast("int")
    marks = F.col("_floor") + F.when(F.col("_left") > 0, more).when(F.col("_left") < 0, -taken).otherwise(0)
    return out.withColumn("marks", F.when(F.col(total) >= F.col("_n"), marks).cast("long")).select(*items.columns, "marks")

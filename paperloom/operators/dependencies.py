"""Dependencies between queued operations: binding, refusal, cycles and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpoint, passing_folder

EDGE = ("operation_id", "depends_on")


def edges(bound: DataFrame) -> DataFrame:
    """(operation_id, depends_on), each once, of rows with operation_id and dependencies, an array."""
    each = bound.select("operation_id", F.explode(F.array_distinct("dependencies")).alias("depends_on")).where("depends_on is not null")
    return each.repartition("operation_id").distinct()  # dealt by operation, as levels joins them


def bind(queue: DataFrame, devices: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (operation_id, account_id, device_id, dependencies; one an operation) with outcome.

    selfDependency: it names itself; unregistered: devices (account_id,
    device_id) has no such pair; notFound: the queue has no such operation
    that is pending or retrying; else bound.
    """
    known = devices.select("account_id", "device_id").distinct().withColumn("_device", F.lit(True))
    open_ = queue.where(F.col("state").isin("pending", "retrying")).select("operation_id").distinct().withColumn("_open", F.lit(True))
    outcome = (
        F.when(F.coalesce(F.array_contains("dependencies", F.col("operation_id")), F.lit(False)), "selfDependency")
        .when(F.col("_device").isNull(), "unregistered")
        .when(F.col("_open").isNull(), "notFound")
        .otherwise("bound")
    )
    joined = requests.join(known, ["account_id", "device_id"], "left").join(open_, "operation_id", "left")
    return joined.withColumn("outcome", outcome).drop("_device", "_open")


def rebound(old: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The edge table after ``bind``: an operation that is bound again has its new edges only."""
    new = outcomes.where("outcome = 'bound'")
    return old.join(new.select("operation_id"), "operation_id", "left_anti").select(*EDGE).union(edges(new).select(*EDGE))


def levels(operations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(operation_id, level, problem) for each operation.

    level is 0 without dependencies, else one more than the highest of those
    it depends on, so operations of one level can be sent together.  Of an
    operation that has no level, problem says why: missing (it depends on
    what is not there), cycle (it depends on itself by way of others), or
    blocked (it depends on one of those).  Repeated edges count once; a self
    edge is a cycle.

    Each round takes away the operations that nothing waits for, whose levels
    follow from the others', and those that wait for nothing any more, whose
    level is the round.  So only edges between operations that are still there
    are joined and written, and rounds are half as many as levels at most.
    What neither takes away lies between cycles, and ``_in_cycle`` decides it.
    Then the former get their levels, those taken last first.
    """
    spark = operations.sparkSession
    root = passing_folder(spark)

    def kept(rows: DataFrame, name: str, *by: str) -> DataFrame:
        rows.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    nodes, given = operations.select("operation_id").distinct(), dependencies.select(*EDGE).where("depends_on is not null").distinct()
    every = kept(nodes.join(given, "operation_id", "left").withColumn("waits", F.col("depends_on").isNotNull()), "every", "waits")
    core, ready = every.where("waits").select(*EDGE), every.where("not waits").select("operation_id")
    there = every.select(F.col("operation_id").alias("depends_on")).distinct()
    absent = kept(core.select("depends_on").distinct().join(there, "depends_on", "left_anti"), "absent")
    missing = kept(core.join(absent, "depends_on", "left_semi").select("operation_id").distinct(), "missing")
    found = kept(ready.withColumn("level", F.lit(0)), "levels")
    tops, starts, level, layers = True, not ready.isEmpty(), 0, []
    while (tops or starts) and not core.isEmpty():
        level += 1
        if tops:
            asked = core.select(F.col("depends_on").alias("operation_id")).distinct().withColumn("_asked", F.lit(True))
            split = core.join(asked, "operation_id", "left").select(*EDGE, F.col("_asked").isNull().alias("top"))
            split = kept(split, f"core{level}", "top")
            core, layer = split.where("not top").select(*EDGE), split.where("top").select(*EDGE)
            tops = not layer.isEmpty()
            layers += [layer] * tops
        if starts:
            done = ready.select(F.col("operation_id").alias("depends_on"))
            freed = kept(core.join(done, "depends_on", "left_semi").select("operation_id").distinct(), f"freed{level}")
            core = core.join(done, "depends_on", "left_anti").select(*EDGE)
            core = core if tops else kept(core, f"rest{level}")  # the next split writes it otherwise
            waiting = core.join(freed, "operation_id", "left_semi").select("operation_id").distinct()
            ready = kept(freed.join(waiting, "operation_id", "left_anti"), f"ready{level}")
            found = kept(ready.withColumn("level", F.lit(level)), "levels")
            starts = not ready.isEmpty()
    core = kept(core, "stuck")
    for layer in reversed(layers):
        # Edges to what has been ready before the layer was taken are gone, and those levels are lower.
        known = layer.join(found.withColumnRenamed("operation_id", "depends_on"), "depends_on", "left")
        own = known.groupBy("operation_id").agg(F.when(F.count("level") == F.count("*"), F.max("level") + 1).alias("level"))
        found = kept(own, "levels")
    found = found.union(core.select("operation_id").distinct().withColumn("level", F.lit(None).cast("int")))
    problem = F.when(F.col("_m"), "missing").when(F.col("_c"), "cycle").when(F.col("level").isNull(), "blocked")
    return (
        found.join(missing.withColumn("_m", F.lit(True)), "operation_id", "left")
        .join(_in_cycle(core).withColumn("_c", F.lit(True)), "operation_id", "left")
        .select("operation_id", "level", problem.alias("problem"))
    )


def _in_cycle(left: DataFrame) -> DataFrame:
    """(operation_id) of the nodes of edges that reach themselves.

    First what waits for others but for which nothing waits goes, round by
    round.  Then each node spreads the least id that reaches it, within what
    its own least id can be reached from, until strongly connected parts are
    told apart: a part is where the least ids forward and backward agree.
    """
    core = left
    while True:
        trimmed = core.join(core.select(F.col("depends_on").alias("operation_id")).distinct(), "operation_id", "left_semi")
        trimmed = trimmed.join(core.select(F.col("operation_id").alias("depends_on")).distinct(), "depends_on", "left_semi").select(*EDGE)
        trimmed = checkpoint(trimmed)
        if trimmed.count() == core.count():
            break
        core = trimmed
    cyclic = core.where("operation_id = depends_on").select("operation_id")
    while not core.isEmpty():
        nodes = core.select("operation_id").union(core.select("depends_on")).distinct()
        forward = _least(nodes, core.select(F.col("depends_on").alias("a"), F.col("operation_id").alias("b")))
        # Within one forward label, what its owner is reached from is the owner's part.
        label = forward.select(F.col("node").alias("operation_id"), "label")
        inside = core.join(label, "operation_id").join(label.select(F.col("operation_id").alias("depends_on"), F.col("label").alias("_l")), "depends_on").where("label = _l")
        inside = checkpoint(inside.select(*EDGE))
        backward = _least(nodes, inside.select(F.col("operation_id").alias("a"), F.col("depends_on").alias("b")))
        part = checkpoint(forward.join(backward.select("node", F.col("label").alias("back")), "node").where("label = back").select("node", "label"))
        large = part.groupBy("label").count().where("count > 1")
        cyclic = checkpoint(cyclic.union(part.join(large, "label", "left_semi").select(F.col("node").alias("operation_id"))).distinct())
        gone = part.select(F.col("node").alias("operation_id"))
        core = core.join(gone, "operation_id", "left_anti").join(gone.select(F.col("operation_id").alias("depends_on")), "depends_on", "left_anti")
        core = checkpoint(core.select(*EDGE))
    return cyclic


def _least(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(node, label): the least node from which ways (a, b) lead to each, itself included."""
    now = checkpoint(nodes.select(F.col("operation_id").alias("node"), F.col("operation_id").alias("label")))
    fresh = now
    while True:
        brought = fresh.join(ways, fresh["node"] == ways["a"]).groupBy("b").agg(F.min("label").alias("_new"))
        joined = now.join(brought, now["node"] == brought["b"], "left").select("node", F.least("label", "_new").alias("label"), (F.col("_new") < F.col("label")).alias("_less"))
        joined = checkpoint(joined)
        now, fresh = joined.select("node", "label"), joined.where("_less").select("node", "label")
        if fresh.isEmpty():
            return now

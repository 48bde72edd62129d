"""Exact Jaccard join of shingle sets in the Jaccard metric space.

Distance is 1 - J, a metric; two sets link within radius r = 1 - threshold.
Most sets are at distance 1 from all others, where no pivot tells them apart,
so space is first cut where distances are below 1: two sets that link have a
rarest common shingle, and it stands so early in both, rarest first, that
enough others can follow (the prefix filter, with the bound on the partner's
size that the place gives).  The sets that hold a shingle so early are a cell.

Cells join by pivots.  A cell's central sets become its pivots and exact
distances to them are measured; distances within r are links, and what they
connect has one label from then on.  A set's home is its nearest pivot, and it
is replicated into the Voronoi cell of each other pivot q with
d(x, q) - d(x, home) <= 2r, since no set with home q can link with it
elsewhere.  The new cells join in the same way, until a cell is small or its
windows no longer part it; then its pairs of different labels are measured
that size, place and distance to a common pivot do not exclude.  A cell of one
label is done.  Every step keeps each link that could join two labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster, sketch
from . import kernels as K
from .components import components
from .sketch import BLOCK, BUCKET

SHINGLE, THRESHOLD = 5, 75
_NO_ID = np.iinfo(np.int64).max
PROFILE = "id long, n long, s1 long, s2 long, candidate boolean, elems binary, sigs array<long>, mosts array<long>, score double"
#: Members of a cell that is not parted, pivots of a larger one.
LEAF, PIVOTS = 64, 4
#: A cell is parted if its Voronoi cells hold at most these shares of its members, in all and each.
ALL_SHARE, ONE_SHARE = 1.5, 0.75
#: Times that a cell is parted at most: its path is the bits of a long.
MAX_DEPTH = 62
#: Members of a cell that one task pairs with others.
BLOCK_MEMBERS = 4096
_DIST = "a long, b long, n_a long, n_b long, both long"


def _sets(texts: pa.ChunkedArray, k: int, key: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and hash of each row's distinct shingles, by row then hash."""
    row, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first, data, off in K.chunks(texts):
        data = K.LOWER[data]
        s, e, fw = K.words(data, off)
        wh = K.slice_hash(data, s, e, key=key)
        place, doc = K.within(fw, k)
        h.append(K.windows(wh, k, 3)[place])
        row.append(doc + first)
        n = np.diff(fw)
        for short in range(1, k):  # fewer words than a shingle has: the whole sequence is one
            own = np.flatnonzero(n == short)
            if len(own):
                h.append(K.windows(wh, short, 10 + short)[fw[own]])
                row.append(own + first)
    row, h = np.concatenate(row), np.concatenate(h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new], len(texts)


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[cut[1:]] - total[cut[:-1]]


def _overlap(batches):
    for batch in batches:
        n = [
            len(np.intersect1d(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64), True))
            for x, y in zip(batch["elems"], batch["b_elems"], strict=True)
        ]
        keep = batch.select(["a", "b", "n_a", "n_b"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(n, pa.int64())], [*keep.schema.names, "both"])


def jaccard_components(
    docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", key: int | None = None
) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row.

    A row's set is its distinct ``shingle``-word shingles, A-Z lower-cased; a
    text of fewer words is one shingle; null, empty and blank texts have empty
    sets and link with nothing.  Rows link when 100 * |A and B| >= threshold *
    |A or B|; component_id is the least id reachable by links, the row's own
    included.  Repeated rows link with each other.  Rows of a null id take
    part in links; component_id is null only where a component has no id.
    Columns other than the id and the text are not read.  An empty table gives
    an empty one.

    Shingles are told apart by 64-bit hashes under a key that is drawn anew
    for each run: texts cannot be made to collide, and by chance two sets
    would have to agree in three quarters of their hashes.
    """
    spark = docs.sparkSession
    cluster.ship(spark)
    secret = K.fresh_key() if key is None else key
    n_buckets, n_blocks = sketch.layout(cluster.text_bytes(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(
        BUCKET, sketch.bucket_of("id", "text", n_buckets)
    )
    grouped = rows.groupBy(BUCKET)

    def count(key, table):
        K.release()
        return sketch.Keys(_sets(table["text"], shingle, secret)[1], n_blocks).parts(key[0].as_py())

    replies = sketch.merged(grouped.applyInArrow(count, sketch.PART))

    def profile(key, table, answer):
        K.release()
        row, h, n_rows = _sets(table["text"], shingle, secret)
        df = sketch.Keys(h, n_blocks).estimates(answer[BLOCK].to_pylist(), answer["counts"].to_pylist())
        cut = np.searchsorted(row, np.arange(n_rows + 1))
        n = np.diff(cut)
        s1, s2 = _sums(K.mix(h), cut), _sums(K.mix(h ^ np.uint64(0x5851F42D4C957F2D)), cut)
        shared = _sums((df >= 2).astype(np.int64), cut)
        ids = pc.fill_null(table["id"], _NO_ID).to_numpy()
        candidate = (n > 0) & (100 * shared >= threshold * n)
        seen, elems, sigs, mosts, score = set(), *([None] * n_rows for _ in range(4))
        for i in np.lexsort((np.arange(n_rows), ids)):
            if not candidate[i] or (same := (int(n[i]), int(s1[i]), int(s2[i]))) in seen:
                continue
            seen.add(same)
            own, d = h[cut[i] : cut[i + 1]], df[cut[i] : cut[i + 1]]
            prefix = np.lexsort((own, d))[: n[i] - (-(-threshold * n[i] // 100)) + 1]
            # If the first common shingle is here, at most the rest is common: a bound on the partner's size.
            most = (100 + threshold) * (n[i] - np.arange(len(prefix))) // threshold - n[i]
            use = (d[prefix] >= 2) & (100 * most >= threshold * n[i])
            elems[i] = np.sort(own.view(np.int64)).tobytes()
            sigs[i] = own[prefix[use]].view(np.int64)
            mosts[i] = most[use]
            score[i] = -float(d.mean())
        return pa.table(
            {
                "id": table["id"],
                "n": pa.array(n, pa.int64()),
                "s1": s1.view(np.int64),
                "s2": s2.view(np.int64),
                "candidate": candidate,
                "elems": pa.array(elems, pa.binary()),
                "sigs": pa.array(sigs, pa.list_(pa.int64())),
                "mosts": pa.array(mosts, pa.list_(pa.int64())),
                "score": pa.array(score, pa.float64()),
            }
        )

    scratch = cluster.Scratch(spark)
    prof = scratch.write(grouped.cogroup(replies.groupBy(BUCKET)).applyInArrow(profile, PROFILE), "profile")
    # Equal sets, by size and two hashes, are one node; each bucket sent its elements once.
    nodes = scratch.write(
        prof.where("elems is not null")
        .select("s1", "s2", "n", "elems", "sigs", "mosts", "score")
        .dropDuplicates(["s1", "s2", "n"])
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    label = components_of_sets(nodes, threshold, scratch)
    same = ["s1", "s2", "n"]
    named = prof.where("candidate").groupBy(*same).agg(F.min("id").alias("least")).join(nodes.select(*same, "node"), same)
    least = named.join(label, "node", "left").select(*same, F.coalesce("label", "node").alias("label"), "least")
    top = least.groupBy("label").agg(F.min("least").alias("component_id"))
    found = least.join(top, "label").select(*same, "component_id", F.lit(True).alias("candidate"))
    rows = prof.join(found, [*same, "candidate"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("candidate"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
    done = scratch.write(rows, "result")
    scratch.keep_only("result")
    return done


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels joined by links (a, b) of nodes, so that earlier components stay whole."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    between = cluster.checkpoint(
        links.join(of("a"), "a").join(of("b"), "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    )
    if between.isEmpty():
        return labels
    ends = between.select(F.col("a").alias("node")).union(between.select("b")).distinct()
    moved = components(ends.select("node", F.col("node").alias("label")), between)
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return cluster.checkpoint(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def components_of_sets(nodes: DataFrame, threshold: int = THRESHOLD, scratch: cluster.Scratch | None = None) -> DataFrame:
    """(node, label) for nodes (node, n, elems, sigs, score[, mosts]) that share a cell with another.

    elems are a set's n hashes, sorted, as bytes of int64; two sets can link
    only where they share an entry of sigs and each one's size is no more than
    the other's entry of mosts at that place (no bound without the column).
    Pivots are the sets of least score.  Equal scores go by node; repeated
    sigs are harmless; a node without sigs has no row.
    """
    cluster.ship(nodes.sparkSession)
    r = 1 - threshold / 100
    scratch = scratch or cluster.Scratch(nodes.sparkSession)
    sets = nodes.select("node", "n", "elems")
    entry = F.arrays_zip("sigs", "mosts") if "mosts" in nodes.columns else F.transform("sigs", lambda x: F.struct(x.alias("sigs"), F.lit(_NO_ID).alias("mosts")))
    meet = nodes.select("node", "n", "score", F.explode(entry).alias("e")).select(
        "node", "n", "score", F.col("e.sigs").alias("cell"), F.col("e.mosts").alias("most")
    )

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, linked, d) for pairs (a, b) of nodes."""
        a = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "elems")
        b = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("elems").alias("b_elems"))
        union = F.col("n_a") + F.col("n_b") - F.col("both")
        return scratch.write(
            pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "elems", "b_elems").mapInArrow(_overlap, _DIST)
            .select("a", "b", (100 * F.col("both") >= threshold * union).alias("linked"), (1 - F.col("both") / union).alias("d")),
            name,
        )

    # Copies share many shingles: cells of the same sets are one, with the wider bound.
    stats = (
        meet.groupBy("cell")
        .agg(
            F.count("*").alias("c"),
            F.min("n").alias("lo"),
            F.max("most").alias("hi"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        .where("c > 1")
    )
    cells = (
        meet.join(stats, "cell")
        .where("most >= lo and n <= hi")
        .groupBy(F.xxhash64("c", "x", "y").alias("cell"), "node", "n", "score")
        .agg(F.max("most").alias("most"))
        .withColumns({"homes": F.lit(0).cast("long"), "d": F.lit(None).cast("double")})
    )
    cells = scratch.write(cells, "cells0")
    labels = cluster.checkpoint(cells.select("node", F.col("node").alias("label")).distinct())
    leaves, depth = None, 0
    while True:
        now = _open(cells, labels)
        slots = F.when(F.col("size") <= LEAF, 1).otherwise(PIVOTS)
        pivots = (
            now.groupBy("cell", F.pmod(F.xxhash64("node", F.lit(depth)), slots).alias("slot"))
            .agg(F.min(F.struct("score", "node", "n", "most", "label")).alias("p"))
            .select("cell", F.col("p.node").alias("pivot"), F.col("p.n").alias("p_n"), F.col("p.most").alias("p_most"), F.col("p.label").alias("p_label"))
        )
        seen = now.join(pivots, "cell")
        # Where a cell is not to be parted, only what may link is measured.
        may_link = (F.col("most") >= F.col("p_n")) & (F.col("p_most") >= F.col("n")) & (F.col("label") != F.col("p_label"))
        want = seen.where((F.col("node") != F.col("pivot")) & ((F.col("size") > LEAF) | may_link))
        dist = measured(want.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), f"dist{depth}")
        before, labels = labels, _relabel(labels, dist.where("linked"))
        at = dist.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("d").alias("p_d"))
        near = (
            _open(cells, before).drop("label", "d")
            .join(pivots.select("cell", "pivot"), "cell")
            .join(at, ["node", "pivot"], "left")
            .groupBy("cell", "node", "n", "score", "most", "homes", "size")
            .agg(F.collect_list(F.struct("p_d", "pivot")).alias("ds"), F.max(F.col("node") == F.col("pivot")).alias("is_pivot"))
            .where("not is_pivot")  # a pivot has met the whole cell
        )
        near = scratch.write(near.withColumn("first", F.array_min(F.transform("ds", lambda x: F.struct(x["pivot"], x["p_d"]))))
                             .withColumn("home", F.array_min("ds")), f"near{depth}")
        wide = near.where(F.col("size") > LEAF)
        parted = wide.withColumn("to", F.explode(F.filter("ds", lambda x: x["p_d"] - F.col("home.p_d") <= 2 * r + 1e-9)))
        fine = (
            parted.groupBy("cell", "size", "to.pivot").count()
            .groupBy("cell", "size").agg(F.sum("count").alias("all"), F.max("count").alias("one"))
            .where((F.col("all") <= ALL_SHARE * F.col("size")) & (F.col("one") <= ONE_SHARE * F.col("size")) & F.lit(depth < MAX_DEPTH))
            .select("cell")
        )
        keep = ["cell", "node", "n", "score", "most", "homes"]
        whole = near.join(fine, "cell", "left_anti").select(*keep, F.col("first.p_d").alias("d"), F.lit(depth).alias("depth"))
        leaves = whole if leaves is None else leaves.union(whole)
        child = parted.join(fine, "cell").select(
            F.xxhash64("cell", "to.pivot", F.lit(depth)).alias("cell"), "node", "n", "score", "most",
            (F.col("homes") * 2 + (F.col("to.pivot") == F.col("home.pivot")).cast("long")).alias("homes"), F.col("to.p_d").alias("d"),
        )
        depth += 1
        cells = scratch.write(child, f"cells{depth}")
        if cells.isEmpty():
            break
    # In a leaf cell, what does not have its commonest label meets what has another label.
    rest = _open(leaves, labels, "depth")
    common = rest.groupBy("cell", "label").count().groupBy("cell").agg(F.max(F.struct("count", "label")).alias("m"))
    blocks = F.ceil(F.col("size") / BLOCK_MEMBERS).cast("long")
    odd = rest.join(common, "cell").where("label <> m.label").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    odd = odd.select("cell", "block", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "most", "homes", "d", "label")])
    all_homes = F.expr("shiftleft(1L, depth) - 1")
    pairs = (
        rest.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
        .join(odd, ["cell", "block"])
        .where("label <> o_label and most >= o_n and o_most >= n")
        .where(F.coalesce(F.abs(F.col("d") - F.col("o_d")) <= r + 1e-9, F.lit(True)))
        .where(F.col("homes").bitwiseOR(F.col("o_homes")) == all_homes)
        .select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))
        .distinct()
    )
    return _relabel(labels, measured(pairs, "last").where("linked"))


def _open(cells: DataFrame, labels: DataFrame, *also: str) -> DataFrame:
    """The members, with label and size, of cells of several labels; without those for which no member has a fitting size."""
    now = cells.join(labels, "node")
    spread = (
        now.groupBy("cell")
        .agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("n").alias("lo"), F.max("most").alias("hi"), F.count("*").alias("size"))
        .where("l0 <> l1")
    )
    return now.join(spread, "cell").where("most >= lo and n <= hi").select(*cells.columns, "label", "size")

"""A Merkle manifest of a dataset: a tree for each group of rows, and one over the groups.

Partial trees are sparse forests: nodes keyed by (tree, level, index) that have
no parent yet.  Two forests join by the union of their nodes, and a run of
siblings collapses to its parent as soon as all are there; how many there must
be follows from the tree's number of leaves, which every node carries.  So the
join is associative, and forests of ranges of rows reduce in rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster, ranks
from .ranks import AT, PART

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: Forests that one task joins, rows of a range, about, and rows whose proofs are held at once.
FAN, RANGE_ROWS, PROOFS = 16, 131_072, 4096
#: The tree over the groups' roots.
TOP = -1
_HEX = 64
_NODE = "block int, run boolean, tree long, n long, level int, at long, digests string, lo int, hi int"
_NODES = pa.schema([("block", pa.int32()), ("run", pa.bool_()), ("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("at", pa.int64()),
                    ("digests", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])


def leaf(*columns: Column) -> Column:
    """sha256 (hex) of a row: each value as ``bytes:value`` in UTF-8, null as ``-``."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _width(n: int, level: int, arity: int) -> int:
    """Nodes of a level in a tree of n leaves."""
    return -(-n // arity**level)


class Forest:
    """Unresolved nodes, by tree and level, and the runs that have collapsed."""

    def __init__(self, groups: int, arity: int):
        self.arity = arity
        self.sizes = {TOP: groups}
        self.nodes: dict[tuple[int, int], dict[int, tuple[str, int, int]]] = {}
        self.runs: dict[tuple[int, int, int], tuple[str, int, int]] = {}

    def add(self, tree: int, n: int, level: int, at: int, node: tuple[str, int, int]) -> None:
        self.sizes[tree] = n
        self.nodes.setdefault((tree, level), {})[at] = node

    def collapse(self) -> Forest:
        for tree in [*sorted(t for t in self.sizes if t != TOP), TOP]:  # roots of groups are leaves of the last
            self._climb(tree, self.sizes[tree])
        return self

    def _climb(self, tree: int, n: int) -> None:
        level = 0
        while (width := _width(n, level, self.arity)) > 1:
            here = self.nodes.get((tree, level), {})
            by_run: dict[int, list[int]] = {}
            for i in here:
                by_run.setdefault(i // self.arity, []).append(i)
            for r, members in by_run.items():
                if len(members) < min(self.arity, width - r * self.arity):
                    continue
                own = [here.pop(i) for i in sorted(members)]
                digests = "".join(d for d, _, _ in own)
                lo, hi = min(x[1] for x in own), max(x[2] for x in own)
                self.runs[tree, level, r] = digests, lo, hi
                self.add(tree, n, level + 1, r, (_hash(digests), lo, hi))
            level += 1
        if tree != TOP and (root := self.nodes.pop((tree, level), None)):
            self.add(TOP, self.sizes[TOP], 0, tree, root[0])

    def table(self, block: int, runs: bool) -> pa.Table:
        rows = [(block, False, t, self.sizes[t], lv, i, *node) for (t, lv), here in self.nodes.items() for i, node in here.items()]
        if runs:
            rows += [(block, True, t, self.sizes[t], lv, r, *run) for (t, lv, r), run in self.runs.items()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES) if rows else _NODES.empty_table()

    def path(self, tree: int, level: int, at: int, known: dict) -> tuple:
        """The siblings before and after a node and after each of its ancestors, up to the root."""
        key = tree, level, at
        if key not in known:
            if _width(self.sizes[tree], level, self.arity) == 1:
                known[key] = () if tree == TOP else self.path(TOP, 0, tree, known)
            else:
                run, k = at // self.arity, at % self.arity * _HEX
                digests = self.runs[tree, level, run][0]
                known[key] = ((digests[:k], digests[k + _HEX :]), *self.path(tree, level + 1, run, known))
        return known[key]

    def root(self, tree: int) -> str | None:
        """The root of a tree of over one leaf."""
        level = 0
        while _width(self.sizes[tree], level, self.arity) > 1:
            level += 1
        return _hash(self.runs[tree, level - 1, 0][0]) if level else None


def _local(table: pa.Table, spans: pa.Table, arity: int) -> tuple[Forest, list[tuple[int, int, str]]]:
    """The forest of a range's rows and (tree, index, leaf) of each row, in the table's order."""
    spans = sorted(spans.to_pylist(), key=lambda s: s["first"])
    forest, placed = Forest(spans[0]["groups"], arity), []
    k, part = 0, spans[0][PART]
    ats, leaves = table[AT].to_pylist(), table["leaf"].to_pylist()
    for at, digest in zip(ats, leaves, strict=True):
        while at > spans[k]["last"]:
            k += 1
        s = spans[k]
        forest.add(s["tree"], s["n"], 0, at - s["start"], (digest, part, part))
        placed.append((s["tree"], at - s["start"], digest))
    return forest.collapse(), placed


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    group_col: str = "lang",
    id_col: str = "doc_id",
    also: dict[str, Column] | None = None,
    arity: int = ARITY,
) -> DataFrame:
    """(id_col, group_col, leaf, subroot, root, proof) and the columns of ``also``, for each row of docs.

    A leaf is the digest of a row's ``columns``.  Leaves of a group ascend by
    id (nulls first, equal ones by a hash of the leaf), each ``arity`` consecutive nodes become
    one, the last run as many as are left, until one is left: the subroot.
    Subroots in order of their group, null first, give the root in the same
    way.  proof is an array, from the leaf up, of (before, after): the
    concatenated digests of the siblings on each side; ``folded`` recomputes a
    root from it.  Repeated rows are leaves of their own.  Nulls, empty and
    very long texts are values like others.  Other columns are not read.  An
    empty table gives an empty one.

    Plan: one scan digests the rows; the digests are ranged by group and id,
    so groups of any size spread; each range makes a forest, and blocks of FAN
    forests join in rounds.  A run that spans ranges goes back to those below
    it, some for each level, and each range proves its own rows.
    """
    spark = docs.sparkSession
    cluster.ship(spark)
    scratch = cluster.Scratch(spark)
    also = also or {}
    made = docs.select(
        F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf(*map(F.col, columns)).alias("leaf"), *[c.alias(f"also_{k}") for k, c in also.items()]
    )
    made = scratch.write(made, "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // RANGE_ROWS))
    rows = ranks.numbered(made, [F.asc("group"), F.asc("id"), F.xxhash64("leaf")], scratch, "ranged", parts)
    spans = scratch.write(rows.groupBy(PART, "group").agg(F.min(AT).alias("first"), F.max(AT).alias("last")), "spans")
    sizes = scratch.write(spans.groupBy("group").agg(F.min("first").alias("start"), (F.max("last") + 1 - F.min("first")).alias("n")), "sizes")
    n_groups = sizes.count()
    trees = ranks.numbered(sizes, [F.asc("group")], scratch, "trees")
    trees = trees.select(F.col("group").alias("of"), "start", "n", F.col(AT).alias("tree"), F.lit(n_groups).alias("groups"))
    spans = spans.join(trees, F.col("group").eqNullSafe(F.col("of"))).select(PART, "first", "last", "start", "n", "tree", "groups")
    spans = scratch.write(spans, "placed")

    def grow(key, table, own):
        return _local(table, own, arity)[0].table(key[0].as_py() // FAN, runs=False)

    def join(key, table):
        forest = Forest(0, arity)
        for _, _, tree, n, level, at, *node in zip(*[c.to_pylist() for c in table.columns], strict=True):
            forest.add(tree, n, level, at, tuple(node))
        forest.sizes[TOP] = n_groups
        return forest.collapse().table(key[0].as_py() // FAN, runs=True)

    by_part = spans.groupBy(PART)
    slim = rows.select(PART, AT, "leaf")
    nodes = cluster.checkpoint(slim.groupBy(PART).cogroup(by_part).applyInArrow(grow, _NODE))
    runs, blocks = None, -(-parts // FAN)
    while True:  # the tree reduction: FAN forests become one
        joined = cluster.checkpoint(nodes.groupBy("block").applyInArrow(join, _NODE))
        new = joined.where("run")
        runs = new if runs is None else runs.union(new)
        nodes = joined.where("not run")
        if blocks == 1:
            break
        blocks = -(-blocks // FAN)
    back = runs.withColumn(PART, F.explode(F.sequence("lo", "hi"))).select(PART, "tree", "n", "level", "at", "digests")
    spare = [f"also_{k}" for k in also]
    proof = "array<struct<before:string,after:string>>"

    def prove(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        is_leaf, is_run = whole["leaf"].is_valid(), whole["level"].is_valid()
        table = whole.filter(is_leaf).combine_chunks()
        forest, placed = _local(table, whole.filter(pc.invert(pc.or_(is_leaf, is_run))), arity)
        for r in whole.filter(is_run).select(["tree", "n", "level", "at", "digests"]).to_pylist():
            forest.sizes[r["tree"]] = r["n"]
            forest.runs[r["tree"], r["level"], r["at"]] = r["digests"], 0, 0
        subroots: dict[int, str] = {}
        for tree, _, digest in placed:
            if tree not in subroots:
                subroots[tree] = forest.root(tree) or digest
        root = forest.root(TOP) or subroots[placed[0][0]]
        table, known = table.select(carried), {}
        for k in range(0, len(placed), PROOFS):
            some = placed[k : k + PROOFS]
            paths = [forest.path(tree, 0, at, known) for tree, at, _ in some]
            sides = pa.StructArray.from_arrays([pa.array([x[i] for p in paths for x in p], pa.string()) for i in (0, 1)], ["before", "after"])
            cut = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in paths])]), pa.int32())
            own = [pa.array([subroots[tree] for tree, _, _ in some]), pa.array([root] * len(some)), pa.ListArray.from_arrays(cut, sides)]
            part = table.slice(k, PROOFS).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns], *own], [*carried, "subroot", "root", "proof"])

    kept = rows.select(PART, AT, "group", "id", "leaf", *spare)
    carried = [c for c in kept.columns if c not in (PART, AT)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in carried)
    around = spans.unionByName(back, allowMissingColumns=True)
    proved = kept.unionByName(around, allowMissingColumns=True).groupBy(PART).applyInArrow(prove, f"{schema}, subroot string, root string, proof {proof}")
    return proved.select(
        F.col("id").alias(id_col), F.col("group").alias(group_col), "leaf", "subroot", "root", "proof", *[F.col(f"also_{k}").alias(k) for k in also]
    )


def siblings_digest(proof: Column) -> Column:
    """sha256 (hex) of all siblings of a proof, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "").cast("binary"), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof give."""
    return F.aggregate(proof, digest, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]).cast("binary"), 256))

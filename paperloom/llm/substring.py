"""Substring deduplication: a count-min prefilter, then exact grouping of what it lets through."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import cluster, sketch
from . import kernels as K
from .sketch import BLOCK, BUCKET

WINDOW = 20
_LAST = np.iinfo(np.int64).max
ADDED = ("n_words", "n_removed", "kept_sha256")


def _ordered(table: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, np.ndarray]:
    """A bucket's rows by id then text, whatever order the shuffle brought them in; null ids come last."""
    table = table.combine_chunks()
    order = pc.sort_indices(table, sort_keys=[(id_col, "ascending"), (text_col, "ascending")])
    table = table.take(order)
    ids = pc.fill_null(table[id_col].combine_chunks().cast(pa.int64()), _LAST).to_numpy(zero_copy_only=False)
    return table, ids


def _scan(texts: pa.ChunkedArray, k: int, key: int = 0):
    """Two hashes, from two hashes of its words, and row and start of each window of a bucket, in order."""
    a, b, row, start = [], [], [], []
    for first, data, off in K.chunks(texts):
        s, e, fw = K.words(data, off)
        h, g = K.slice_hashes(data, s, e, (0, 1), key)
        place, doc = K.within(fw, k)
        a.append(K.windows(h, k, 1)[place])
        b.append(K.windows(g, k, 2)[place])
        row.append(doc + first)
        start.append(place - fw[doc])
    empty = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return [np.concatenate(x or empty[i > 1]) for i, x in enumerate((a, b, row, start))]


def _first_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes of the first of each distinct (a, b)."""
    order = np.lexsort((np.arange(len(a)), b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


_SENT = pa.schema(
    [(BUCKET, pa.int32()), (BLOCK, pa.int32())] + [(n, pa.binary()) for n in ("h1", "h2", "ids", "runs")]
)


def _first_bits(key, parts):
    """For each window that a bucket sent, whether no other sent it with a smaller id, or the same id from a smaller bucket."""
    K.release()
    parts = parts.combine_chunks()
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in parts[name]]
    h1, h2 = read("h1", np.uint64), read("h2", np.uint64)
    ids = [np.repeat(i, n) for i, n in zip(read("ids", np.int64), read("runs", np.int64), strict=True)]
    cut = np.cumsum([len(x) for x in h1])
    a, b, ids = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
    bucket = np.repeat(parts[BUCKET].to_numpy(), [len(x) for x in h1])
    order = np.lexsort((bucket, ids, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.zeros(len(a), bool)
    first[order[new]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(first, cut[:-1])]
    return pa.table({BUCKET: parts[BUCKET], BLOCK: parts[BLOCK], "firsts": pa.array(bits, pa.binary())})


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut from each text the words of windows that start earlier in the corpus.

    A window is ``window`` consecutive words of one row.  A word goes if some
    window over it has a word sequence that also starts earlier: in a row of a
    smaller id, or earlier in the same row.  Windows are judged on the input.

    Returns the input columns, the text replaced by its kept words joined by
    one space, and n_words, n_removed (long) and kept_sha256 (lowercase hex);
    input columns of those names are replaced.  Null and empty texts have no
    words and become empty texts.  Rows of a null id count as later than all
    others.  Rows that share an id follow one another in an order that a hash
    of their texts gives, so a repeated row loses what its first copy keeps.
    An empty table gives an empty one.

    Plan: rows are dealt by a hash of id and text once (that exchange serves all
    three passes); a corpus-sized count-min sketch is merged in blocks; only
    windows estimated to repeat are grouped, by two independent 64-bit hashes
    under a key drawn anew for each run, each sent once by a bucket and
    answered with a bit.
    """
    spark = docs.sparkSession
    cluster.ship(spark)
    secret = K.fresh_key()
    n_buckets, n_blocks = sketch.layout(cluster.text_bytes(docs, text_col))
    docs = docs.drop(*ADDED)
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in docs.schema.fields]
        + [T.StructField(n, T.LongType()) for n in ADDED[:2]]
        + [T.StructField(ADDED[2], T.StringType())]
    )
    rows = docs.withColumn(BUCKET, sketch.bucket_of(id_col, text_col, n_buckets))
    grouped = rows.groupBy(BUCKET)

    def count(key, table):
        table, _ = _ordered(table, id_col, text_col)
        K.release()
        a = _scan(table[text_col], window, secret)[0]
        return sketch.Keys(a, n_blocks).parts(key[0].as_py())

    replies = sketch.merged(grouped.applyInArrow(count, sketch.PART))

    def judge(table: pa.Table, answer: pa.Table):
        K.release()
        table, ids = _ordered(table, id_col, text_col)
        a, b, row, start = _scan(table[text_col], window, secret)
        est = sketch.Keys(a, n_blocks).estimates(answer[BLOCK].to_pylist(), answer["counts"].to_pylist())
        maybe = np.flatnonzero(est >= 2)
        return table, ids, a[maybe], b[maybe], row[maybe], start[maybe]

    def sent(a, b):
        """The windows a bucket sends, each once, as (block, their indexes in document order)."""
        i = np.sort(_first_of(a, b))
        block = sketch.block_of(a[i], n_blocks)
        order = np.argsort(block, kind="stable")
        cut = np.searchsorted(block[order], np.arange(n_blocks + 1))
        return [(x, i[order[cut[x] : cut[x + 1]]]) for x in np.flatnonzero(np.diff(cut)).tolist()]

    def candidates(key, table, answer):
        _, ids, a, b, row, _ = judge(table, answer)
        out = {BUCKET: [], BLOCK: [], "h1": [], "h2": [], "ids": [], "runs": []}
        for block, i in sent(a, b):
            own, runs = np.unique(ids[row[i]], return_counts=True)
            values = key[0].as_py(), block, a[i].tobytes(), b[i].tobytes(), own.tobytes(), runs.tobytes()
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return pa.table(out, schema=_SENT)

    sent_windows = grouped.cogroup(replies.groupBy(BUCKET)).applyInArrow(
        candidates, f"{BUCKET} int, {BLOCK} int, h1 binary, h2 binary, ids binary, runs binary"
    )
    firsts = sent_windows.groupBy(BLOCK).applyInArrow(_first_bits, f"{BUCKET} int, {BLOCK} int, firsts binary")
    known = replies.unionByName(firsts, allowMissingColumns=True)

    def cut(key, table, answer):
        is_first = pc.is_valid(answer["firsts"])
        table, _, a, b, row, start = judge(table, answer.filter(pc.invert(is_first)))
        first = answer.filter(is_first)
        bits = dict(zip(first[BLOCK].to_pylist(), first["firsts"].to_pylist(), strict=True))
        gone = np.ones(len(row), bool)
        for block, i in sent(a, b):
            gone[i] = np.unpackbits(np.frombuffer(bits[block], np.uint8), count=len(i)) == 0
        return _rewrite(table, row[gone], start[gone])

    def _rewrite(table: pa.Table, row: np.ndarray, start: np.ndarray) -> pa.Table:
        n_words, n_removed, texts, hashes = [], [], [], []
        for first, data, off in K.chunks(table[text_col]):
            s, e, fw = K.words(data, off)
            lo, hi = np.searchsorted(row, [first, first + len(off) - 1])
            at = fw[row[lo:hi] - first] + start[lo:hi]
            change = np.zeros(len(s) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            keep = np.cumsum(change)[:-1] == 0
            out = data.copy()
            out[e] = 0x20
            mask = np.zeros(len(data) + 1, np.int8)
            mask[s[keep]] = 1
            mask[e[keep] + 1] -= 1
            mask = np.cumsum(mask[:-1], dtype=np.int8).view(bool)
            body = out[mask].tobytes()
            at = np.concatenate([[0], np.cumsum(mask)])[off]
            total = np.concatenate([[0], np.cumsum(keep)])[fw]
            for i in range(len(off) - 1):
                text = body[at[i] : max(at[i], at[i + 1] - 1)]
                n_words.append(fw[i + 1] - fw[i])
                n_removed.append(fw[i + 1] - fw[i] - (total[i + 1] - total[i]))
                texts.append(text)
                hashes.append(hashlib.sha256(text).hexdigest())
        new = table.drop_columns([BUCKET])
        new = new.set_column(new.column_names.index(text_col), text_col, pa.array(texts, pa.binary()).cast(pa.string()))
        for name, values in zip(ADDED, (n_words, n_removed, hashes), strict=True):
            new = new.append_column(name, pa.array(values, pa.string() if name == ADDED[2] else pa.int64()))
        return new

    return grouped.cogroup(known.groupBy(BUCKET)).applyInArrow(cut, schema)

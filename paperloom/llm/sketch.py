"""A count-min sketch that grows with the corpus and is never held whole.

Documents are dealt into buckets by a hash of id and text, so neither null nor
repeated ids meet in one bucket, only equal rows do.  Each bucket counts its
own keys and cuts that partial sketch into blocks by key hash; a block's parts
from all buckets merge in one task, so a block, not the sketch, bounds memory.
The merged estimates go back to each bucket that asked, in the order of its own
keys.  A key occurs at most once per bucket in what is sent, however often the
bucket holds it, so a hot key costs one entry per bucket.

An estimate is the least of ``ROWS`` counters and never below the true count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BUCKET, BLOCK = "_pl_bucket", "_pl_block"
#: Text of a bucket and keys of a block, about: what one task holds.
BUCKET_BYTES, BLOCK_KEYS = 4 << 20, 2 << 20
ROWS, WIDTH_BITS = 2, 23
TOP = 255
PART = f"{BUCKET} int, {BLOCK} int, keys binary, counts binary"
REPLY = f"{BUCKET} int, {BLOCK} int, counts binary"


def layout(n_bytes: int) -> tuple[int, int]:
    """Numbers of buckets and blocks for a corpus of so many bytes (a key for each six bytes, about)."""
    return max(32, -(-n_bytes // BUCKET_BYTES)), max(16, -(-n_bytes // (6 * BLOCK_KEYS)))


def bucket_of(id_col: str, text_col: str, n: int):
    """The bucket of a document."""
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")


def block_of(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(n_blocks)


class Keys:
    """The distinct keys of one bucket, in an order that only their values decide."""

    def __init__(self, hashes: np.ndarray, n_blocks: int):
        block = block_of(hashes, n_blocks)
        key = (block << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        self.keys, self.place, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        self.cut = np.searchsorted(self.keys, np.arange(n_blocks + 1, dtype=np.uint64) << np.uint64(32))

    def parts(self, bucket: int) -> pa.Table:
        own = np.flatnonzero(np.diff(self.cut)).tolist()
        low = self.keys & np.uint64(0xFFFFFFFF)
        n = np.minimum(self.counts, TOP).astype(np.uint8)
        spans = [slice(self.cut[b], self.cut[b + 1]) for b in own]
        return pa.table(
            {
                BUCKET: pa.array([bucket] * len(own), pa.int32()),
                BLOCK: pa.array(own, pa.int32()),
                "keys": pa.array([K.pack_sorted(low[s]) for s in spans], pa.binary()),
                "counts": pa.array([n[s].tobytes() for s in spans], pa.binary()),
            }
        )

    def estimates(self, blocks, counts) -> np.ndarray:
        """The estimate for each hash given at first, from the replies to this bucket."""
        est = np.zeros(len(self.keys), np.uint8)
        for b, c in zip(blocks, counts, strict=True):
            if b is not None:
                est[self.cut[b] : self.cut[b + 1]] = np.frombuffer(c, np.uint8)
        return est[self.place]


def _cells(keys: np.ndarray) -> list[np.ndarray]:
    h = K.mix(keys.astype(np.uint64))
    return [((h >> np.uint64(32 * r)) & np.uint64((1 << WIDTH_BITS) - 1)).astype(np.int64) for r in range(ROWS)]


def _merge(key, parts):
    K.release()
    rows = [np.zeros(1 << WIDTH_BITS, np.uint32) for _ in range(ROWS)]
    names = parts.column_names
    packed, counts = parts.column(names.index("keys")), parts.column(names.index("counts"))
    for p, c in zip(packed, counts, strict=True):
        add = np.frombuffer(c.as_buffer(), np.uint8).astype(np.uint32)
        for row, cell in zip(rows, _cells(K.unpack_sorted(p.as_buffer())), strict=True):
            np.add.at(row, cell, add)
    for row in rows:
        np.minimum(row, TOP, out=row)
    out = []
    for p in packed:
        cells = _cells(K.unpack_sorted(p.as_buffer()))
        out.append(np.minimum.reduce([row[c] for row, c in zip(rows, cells, strict=True)]).astype(np.uint8).tobytes())
    return pa.table({BUCKET: parts[BUCKET], BLOCK: parts[BLOCK], "counts": pa.array(out, pa.binary())})


def merged(parts: DataFrame) -> DataFrame:
    """Partial sketches (``PART``) to the estimates for each bucket's own keys (``REPLY``)."""
    return parts.groupBy(BLOCK).applyInArrow(_merge, REPLY)

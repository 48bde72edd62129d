"""Vectorised words and windows over Arrow text columns.

Everything here works on one Arrow batch inside a task.  A word is a maximal
run of bytes outside ``\x20 \x09-\x0D``; UTF-8 keeps that exact on bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_GOLDEN = 0x9E3779B97F4A7C15
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is free again back to the system: a worker lives for many groups, and its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(seed))


_SEEDS = [int(x) for x in _stream(8, 11)]
_LANE_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Slices of more lanes of eight bytes are digested whole.
LANES = 16


def lay(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each closed by a newline, and the n + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    s = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    t = pc.binary_join_element_wise(t, *s)
    if isinstance(t, pa.ChunkedArray):
        t = t.combine_chunks()
    if len(t) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def chunks(texts, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, off = lay(texts)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 indexes of each text's first word."""
    step = np.diff((~SPACE[data]).astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, ends, np.searchsorted(starts, off)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number; zeros follow the data."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def fresh_key() -> int:
    """64 random bits.  Drawn once a run on the driver, they make hashes that nobody can foresee, so no text can be made to collide."""
    return secrets.randbits(64)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...], key: int = 0) -> list[np.ndarray]:
    """A 64-bit hash of each slice for each seed: its lanes of eight bytes go one by one through ``mix``, from a start that the key hides.

    ``mix`` has an inverse, so slices of one length up to eight bytes never collide.  Odd seeds take the
    lanes from the last to the first, so a pair that one seed confuses is nothing special to another.
    """
    view, n = _lanes(data), ends - starts
    lanes = np.maximum(-(-n // 8), 1)
    hidden = [_SEEDS[s] ^ int(mix(np.array([(key + s * _GOLDEN) % 2**64], np.uint64))[0]) for s in seeds]

    def lane(k: int, at: np.ndarray | slice, seed: int) -> np.ndarray:
        i = lanes[at] - 1 - k if seed % 2 else k
        return view[starts[at] + 8 * i] & _LANE_MASK[np.clip(n[at] - 8 * i, 0, 8)]

    out = [mix(lane(0, slice(None), s) ^ np.uint64(x)) for s, x in zip(seeds, hidden, strict=True)]
    more = np.flatnonzero((n > 8) & (n <= 8 * LANES))
    for k in range(1, LANES):
        if not len(more):
            break
        for h, s in zip(out, seeds, strict=True):
            h[more] = mix(h[more] ^ lane(k, more, s))
        more = more[n[more] > 8 * (k + 1)]
    for i in np.flatnonzero(n > 8 * LANES).tolist():
        whole = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=64, key=key.to_bytes(8, "little")).digest()
        for h, s in zip(out, seeds, strict=True):
            h[i] = int.from_bytes(whole[8 * s : 8 * s + 8], "little")
    length = n.astype(np.uint64) * np.uint64(_GOLDEN)
    return [mix(h + length) for h in out]


def slice_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice."""
    return slice_hashes(data, starts, ends, (seed,), key)[0]


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each distinct slice, and the place among them of every slice; equal means equal bytes."""
    h, n = slice_hash(data, starts, ends), ends - starts
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    rep = first[back]
    odd = n != n[rep]
    view = _lanes(data)
    at = np.flatnonzero(~odd & (n <= 8 * LANES))
    for k in range(LANES):
        at = at[n[at] > 8 * k]
        if not len(at):
            break
        mask = _LANE_MASK[np.minimum(n[at] - 8 * k, 8)]
        odd[at] |= ((view[starts[at] + 8 * k] ^ view[starts[rep[at]] + 8 * k]) & mask) != 0
    for i in np.flatnonzero(~odd & (n > 8 * LANES)).tolist():
        r = int(rep[i])
        odd[i] = r != i and not np.array_equal(data[starts[i] : ends[i]], data[starts[r] : ends[r]])
    if odd.any():  # two byte strings of one hash: number the odd ones by their bytes
        own: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(odd).tolist():
            raw = data[starts[i] : ends[i]].tobytes()
            if raw not in own:
                own[raw] = len(first) + len(extra)
                extra.append(i)
            back[i] = own[raw]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, back


def windows(word_hash: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k words from each place, for all places with k words left."""
    n = max(0, len(word_hash) - k + 1)
    m = _stream(k, 1000 + seed) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += word_hash[j : j + n] * m[j]
    return mix(out)


def within(first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose k words lie in one text, and that text, both in order."""
    n = np.maximum(np.diff(first_word) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_word[:-1], n)
    return place, doc


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each of many runs, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as byte planes of their gaps, which compress well in a shuffle."""
    gaps = np.diff(values.astype(np.int64), prepend=0).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<u4").ravel(), dtype=np.int64)

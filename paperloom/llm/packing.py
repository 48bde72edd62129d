"""Best-two-fit packing of token sequences, planned on the histogram of lengths.

A bin is filled greedily, the longest piece that fits first; then its smallest
piece makes way for two unpacked ones if some pair fits the widened gap more
tightly.  Only lengths matter, and there are at most as many as the capacity,
so the plan is made on their counts: a filled bin is a pattern that repeats
until one of its lengths runs out.  Pieces then find their places by their
rank among pieces of their length, so no task packs more than a plan row.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cluster
from . import kernels as K

CAPACITY = 2048
END_ID = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, copies in a bin, first bin, offset) that place all pieces.

    Rank k of a length, from its row's first, goes to bin first + k // copies
    at offset + k % copies * length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must be 1 to {capacity}")
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while lengths:
        pattern: dict[int, int] = {}
        gap = capacity
        k = len(lengths)
        while gap and (k := min(bisect_right(lengths, gap), k)):
            n = lengths[k - 1]
            take = min(left[n], gap // n)
            pattern[n] = take
            gap -= take * n
            k -= 1
        if gap:
            small = min(pattern)
            pattern[small] -= 1
            pair = _best_two(lengths, {n: left[n] - pattern.get(n, 0) for n in lengths}, gap + small, small)
            for n in pair or (small,):
                pattern[n] = pattern.get(n, 0) + 1
        pattern = {n: c for n, c in pattern.items() if c}
        times = min(left[n] // c for n, c in pattern.items())
        offset = 0
        for n, c in sorted(pattern.items(), reverse=True):
            rows.append((n, used[n], times * c, c, bins, offset))
            used[n] += times * c
            left[n] -= times * c
            offset += c * n
            if not left[n]:
                lengths.remove(n)
        bins += times
    return rows


def _best_two(lengths: list[int], free: dict[int, int], gap: int, more_than: int) -> tuple[int, int] | None:
    """The pair of free lengths with the largest sum up to ``gap``, if that is over ``more_than``."""
    own = np.array([n for n in lengths if n < gap and free[n] > 0])
    if not len(own):
        return None
    at = np.searchsorted(own, np.minimum(gap - own, own), "right") - 1  # the other is no longer than the first
    same = (at >= 0) & (own[at] == own) & (np.array([free[n] for n in own.tolist()]) < 2)
    at = at - same
    total = np.where(at >= 0, own + own[at], 0)
    best = int(np.argmax(total))
    return (int(own[best]), int(own[at[best]])) if total[best] > more_than else None


#: Words that one call of the tokenizer encodes.
GROUP = 128


class WordTokens:
    """Token ids of blank-separated words from a library tokenizer, each distinct word once while the cache holds it.

    Word vocabularies drop white space and no token spans it, so a text's ids
    are its words' ids in a row.  Added tokens are matched in the text before
    words are; a text that holds one is encoded whole.
    """

    #: Words in the cache at most, their bytes, and words that stay when a task ends.
    LIMIT, BYTES, STAY = 800_000, 32 << 20, 300_000

    def __init__(self, file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.between = self._between()
        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def shrink(self, most: int) -> None:
        """Keep at most so many words, those that most chunks have used, twice at least."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argpartition(-self.uses[keep], most)[:most]])
        words = list(self.place)  # in the order of their entries
        words = [words[i] for i in keep.tolist()]
        self.flat = self.flat[K.ragged(self.starts[keep], self.sizes[keep])]
        self.sizes, self.uses = self.sizes[keep], self.uses[keep] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = dict(zip(words, range(len(words)), strict=True))
        self.bytes = sum(map(len, words))

    def _between(self) -> tuple[str, int] | None:
        """A word of the vocabulary that is always one token of its own, and that token; None if none is found at once."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        for token, i in sorted(self.tokenizer.get_vocab().items(), key=lambda x: -x[1])[:2000]:
            word = token.removesuffix("</w>")
            if word.isascii() and word.isalpha() and len(word) > 4 and ids(f"a {word} 1") == [*ids("a"), i, *ids("1")]:
                return word, i
        return None

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words one after another, and their number for each word.

        Many words are one call, with a word between them whose token tells where they end; a group that
        holds that token itself is encoded word by word.
        """
        flat, sizes = [], []
        groups = [words[k : k + GROUP] for k in range(0, len(words), GROUP)]
        joined = self.tokenizer.encode_batch_fast([f" {self.between[0]} ".join(g) for g in groups], add_special_tokens=False) if self.between else [None] * len(groups)
        for group, e in zip(groups, joined, strict=True):
            ids = np.array(e.ids if e else [], np.uint32)
            cut = np.flatnonzero(ids == self.between[1]) if e else []
            if e and len(cut) == len(group) - 1:
                flat.append(np.delete(ids, cut))
                sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
            else:
                own = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                flat.append(np.fromiter(chain.from_iterable(own), np.uint32))
                sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
        return np.concatenate(flat), np.concatenate(sizes)

    def _add(self, words: list[bytes]) -> np.ndarray:
        flat, sizes = self._ids([w.decode() for w in words])
        place = np.arange(len(self.sizes), len(self.sizes) + len(words))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.place.update(zip(words, place.tolist(), strict=True))
        self.bytes += sum(map(len, words))
        return place

    def _whole(self, raw: bytes, off: np.ndarray) -> list[int]:
        """Texts of a chunk that hold an added token."""
        return sorted({int(np.searchsorted(off, m.start(), "right")) - 1 for t in self.added for m in re.finditer(re.escape(t), raw)})

    def encode(self, texts):
        """(first row, token ids of a run of texts, n + 1 offsets by text); each text ends with END_ID."""
        for row, data, off in K.chunks(texts, 2 * K.CHUNK_BYTES):
            if len(self.sizes) > self.LIMIT or self.bytes > self.BYTES:
                self.shrink(self.LIMIT // 2)
            s, e, fw = K.words(data, off)
            first, back = K.distinct_slices(data, s, e)
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
            find = self.place.get
            entry = np.fromiter([find(w, -1) for w in words], np.int64, len(words))
            missing = np.flatnonzero(entry < 0)
            if len(missing):
                entry[missing] = self._add([words[k] for k in missing.tolist()])
            self.uses[entry] += 1
            entry = entry[back]
            sizes = self.sizes[entry]
            upto = np.concatenate([[0], np.cumsum(sizes)])[fw]
            ids = self.flat[K.ragged(self.starts[entry], sizes)]
            own = self._whole(raw, off)
            if own:
                parts = [ids[upto[i] : upto[i + 1]] for i in range(len(off) - 1)]
                for i in own:
                    text = raw[off[i] : off[i + 1] - 1].decode()
                    parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                upto = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                ids = np.concatenate(parts)
            yield row, np.insert(ids, upto[1:], END_ID), upto + np.arange(len(upto))


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(file: bytes) -> WordTokens:
    key = hashlib.sha256(file).hexdigest()
    if key not in _TOKENS:
        _TOKENS[key] = WordTokens(file)
    return _TOKENS[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str, ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for each row: its tokens and END_ID, cut at the capacity."""
    spark = docs.sparkSession
    cluster.ship(spark)
    with open(tokenizer_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # a vocabulary file
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def run(batches):
        own = word_tokens(file.value)
        for batch in batches:
            for row, tokens, off in own.encode(batch["text"]):
                tokens = tokens.astype("<u4", copy=False)
                n = np.diff(off)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = K.ragged(np.zeros(len(n), np.int64), count)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                at = off[doc] + start
                cut = [tokens[a : a + m] for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [
                    batch["id"].take(pa.array(doc + row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)
        own.shrink(own.STAY)  # a worker lives on, and its memory with it

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece's place.

    A row's tokens are its words' ids and END_ID; only rows of more than
    ``capacity`` tokens are cut, at multiples of it.  Null and empty texts are
    the one token END_ID.  Null and repeated ids are packed like others; equal
    pieces are interchangeable.  Offsets in a sequence are gapless from 0.  An
    empty table gives an empty one.

    The histogram of lengths (at most ``capacity`` rows) is all that reaches
    the driver, and the plan made of it all that is broadcast.
    """
    spark = docs.sparkSession
    scratch = cluster.Scratch(spark)
    found = scratch.write(pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    rows = plan(histogram, capacity)
    plan_schema = "p_length long, p_first long, p_ranks long, p_copies long, p_bin long, p_offset long"
    places = spark.createDataFrame(rows, plan_schema)
    # Ranks by length: counts of each chunk of rows, prefix sums over chunks, and rows within a chunk.
    chunks = max(1, round((sum(histogram.values()) / 1024) ** 0.5))
    found = found.withColumn("chunk", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(chunks)))
    upto = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        found.groupBy("length", "chunk")
        .count()
        .select("length", "chunk", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "chunk").orderBy("id", "piece", "ids_crc32")
    ranked = (
        found.withColumn("nth", F.row_number().over(within) - 1)
        .join(before, ["length", "chunk"])
        .withColumn("rank", F.col("nth") + F.col("before"))
    )
    k = F.col("rank") - F.col("p_first")
    placed = ranked.join(
        F.broadcast(places),  # some rows for each length, at most
        (F.col("length") == F.col("p_length")) & (k >= 0) & (k < F.col("p_ranks")),
    )
    return placed.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("p_bin") + F.floor(k / F.col("p_copies"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + k % F.col("p_copies") * F.col("length")).cast("long").alias("offset"),
        *["ids"] * with_ids,
    )

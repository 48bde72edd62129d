"""Byte-level BPE: boundaries by a transition-function scan, cached pair merging, and decoding.

The split pattern is the common one of byte-level vocabularies::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

It is a finite automaton over codepoint classes that look two characters ahead.
Every character is a function from states to states; functions compose, and
composition is associative, so prefixes are scanned in blocks with array
operations and no regular expression.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import cluster
from . import kernels as K

# Unicode White_Space, as listed in PropList (fixed values).
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
_CLASS = np.full(0x110000, OTHER, np.uint8)
_PAGES = np.zeros(0x1100, bool)

#: What a character does: its class, and for apostrophes and spaces what follows.
S_LETTER, S_NUMBER, S_OTHER, S_CUT2, S_CUT3, S_LEAD, S_LONE, S_SPACES, S_END = range(9)
#: Where a text stands: before a token, in a run, after a leading space, or inside a contraction.
FRESH, IN_L, IN_N, IN_O, IN_S, LED, ONE_MORE, TWO_MORE = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by 8 * symbol + state."""
    to, new = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, run in ((S_LETTER, IN_L), (S_NUMBER, IN_N), (S_OTHER, IN_O)):
        to[symbol] = run
        new[symbol, [run, LED]] = False
    to[S_LETTER, [ONE_MORE, TWO_MORE]] = FRESH, ONE_MORE
    new[S_LETTER, [ONE_MORE, TWO_MORE]] = False
    for symbol, rest in ((S_CUT2, ONE_MORE), (S_CUT3, TWO_MORE)):
        to[symbol] = rest
        to[symbol, [IN_O, LED]] = IN_O
        new[symbol, [IN_O, LED]] = False
    to[S_LEAD], to[S_LONE], to[S_SPACES], to[S_END] = LED, FRESH, IN_S, FRESH
    new[S_SPACES, IN_S] = False
    return to.ravel(), new.ravel()


_TO, _NEW = _automaton()
_BLOCK = 64


def classes(cps: np.ndarray) -> np.ndarray:
    """Class of each codepoint; 256-codepoint pages of the table are filled when first met."""
    for page in np.flatnonzero((np.bincount(cps >> 8, minlength=0x1100) > 0) & ~_PAGES):
        for c in range(page << 8, (page + 1) << 8):
            kind = unicodedata.category(chr(c))[0]
            _CLASS[c] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
        _PAGES[page] = True
        for c in WHITE_SPACE:
            if c >> 8 == page:
                _CLASS[c] = BLANK if c == 0x20 else SPACE
    return _CLASS[cps]


def _symbols(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of texts that each close with a character at ``ends``."""
    cls = classes(cps)
    blank = cls >= BLANK
    blank[ends] = True
    after_blank = np.append(blank[1:], True)
    sym = cls.copy()
    sym[blank] = np.where(after_blank[blank], S_SPACES, np.where(cls[blank] == BLANK, S_LEAD, S_LONE))
    at = np.flatnonzero(cps == ord("'"))
    pad = np.append(cps, [0, 0])
    a, b = pad[at + 1], pad[at + 2]
    is_ = lambda x, chars: np.isin(x, [ord(c) for c in chars])
    sym[at[is_(a, "stmd")]] = S_CUT2
    sym[at[(is_(a, "rv") & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]] = S_CUT3
    sym[ends] = S_END
    return sym


def token_starts(sym: np.ndarray) -> np.ndarray:
    """Whether a token starts at each symbol."""
    n = len(sym)
    cols = -(-n // _BLOCK)
    grid = np.full(cols * _BLOCK, S_END, np.int32)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(cols, _BLOCK).T) * 8
    # each block as one function of the state before it
    f = np.tile(np.arange(8, dtype=np.uint8), (cols, 1))
    for row in grid:
        f = _TO[row[:, None] + f]
    # prefix compositions by doubling
    step = 1
    while step < cols:
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), 1)
        step *= 2
    state = np.empty(cols, np.uint8)
    state[0], state[1:] = FRESH, f[:-1, FRESH]
    new = np.empty(grid.shape, bool)
    for j, row in enumerate(grid):
        at = row + state
        new[j] = _NEW[at]
        state = _TO[at]
    return new.T.ravel()[:n]


class Vocabulary:
    """Ranks of byte strings, as arrays for merging pairs of many slices at once."""

    def __init__(self, ranks_file: bytes):
        pairs = (line.split() for line in ranks_file.splitlines() if line)
        self.rank = {base64.b64decode(t): int(r) for t, r in pairs}
        self.token = dict(zip(self.rank.values(), self.rank.keys(), strict=True))
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                if (a := self.rank.get(t[:i])) is not None and (b := self.rank.get(t[i:])) is not None:
                    left.append(a), right.append(b), made.append(r)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.made = key[order], np.array(made, np.int64)[order]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.made[at], np.iinfo(np.int64).max)

    def merge(self, slices: list[bytes]) -> list[np.ndarray]:
        """Token ids of each slice: the lowest-ranked adjacent pair merges first, the leftmost of equals."""
        out: list[np.ndarray] = [None] * len(slices)
        rest = []
        for i, s in enumerate(slices):
            if (r := self.rank.get(s)) is not None:
                out[i] = np.array([r])
            else:
                rest.append(i)
        if not rest:
            return out
        n = np.array([len(slices[i]) for i in rest])
        tok = self.byte[np.frombuffer(b"".join(slices[i] for i in rest), np.uint8)]
        own = np.repeat(np.array(rest), n)
        none = np.iinfo(np.int64).max
        while len(tok):
            rank = np.full(len(tok), none)
            rank[:-1] = np.where(own[:-1] == own[1:], self.pair_ranks(tok[:-1], tok[1:]), none)
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            least = np.minimum.reduceat(rank, cut)
            size = np.diff(np.append(cut, len(tok)))
            for k in np.flatnonzero(least == none):
                out[own[cut[k]]] = tok[cut[k] : cut[k] + size[k]]
            live = np.repeat(least != none, size)
            hit = np.flatnonzero(live & (rank == np.repeat(least, size)))
            # of touching pairs, every other one from the left
            start = np.diff(hit, prepend=-2) != 1
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            tok[hit] = rank[hit]
            live[hit + 1] = False
            tok, own = tok[live], own[live]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Coder:
    """Encodes batches; distinct slices merge once while the bounded cache, which is keyed by their bytes, holds them."""

    #: Slices in the cache at most, and their bytes: long unbroken texts are slices too.
    LIMIT, BYTES = 300_000, 16 << 20

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.bytes = 0
        self.place: dict[bytes, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.decimal: list[bytes] = []
        self.raw: list[bytes] = []

    def encode(self, texts: list[str]):
        """(first text, entry of each slice, n + 1 slice indexes by text, byte offsets by slice) of runs of texts."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= K.CHUNK_BYTES):
                size += len(texts[j])
                j += 1
            yield (i, *self._run(texts[i:j]))
            i = j

    def _run(self, texts: list[str]):
        if len(self.place) > self.LIMIT or self.bytes > self.BYTES:
            self._clear()
        joined = "\n".join(texts) + "\n"
        cps = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        data = np.frombuffer(joined.encode(), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        new = token_starts(_symbols(cps, ends))
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000), out=at[1:])
        edge = np.flatnonzero(new)  # the closing characters are edges too, and start no slice
        closing = np.zeros(len(cps), bool)
        closing[ends] = True
        is_slice = ~closing[edge]
        starts, stops = at[edge[is_slice]], at[np.append(edge[1:], len(cps))[is_slice]]
        per_text = np.searchsorted(edge[is_slice], np.concatenate([[0], ends + 1]))
        first, back = K.distinct_slices(data, starts, stops)
        raw = data.tobytes()
        slices = [raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        entry = np.fromiter([self.place.get(x, -1) for x in slices], np.int64, len(slices))
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            merged = self.vocabulary.merge([slices[k] for k in missing.tolist()])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, merged), np.int64, len(merged))])
            for x, ids in zip(missing.tolist(), merged, strict=True):
                entry[x] = self.place[slices[x]] = len(self.ids)
                self.bytes += len(slices[x])
                self.ids.append(ids.astype(np.int32))
                self.decimal.append((" ".join(map(str, ids.tolist())) + " ").encode())
                self.raw.append(self.vocabulary.decode(ids.tolist()))
        text_at = at[np.concatenate([[0], ends + 1])]
        offsets = starts - np.repeat(text_at[:-1], np.diff(per_text))
        return entry[back], per_text, offsets


_CODERS: dict[str, Coder] = {}


def coder(ranks_file: bytes) -> Coder:
    key = hashlib.sha256(ranks_file).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(Vocabulary(ranks_file))
    return _CODERS[key]


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, slice_tokens array<int>, slice_offsets array<int>) for each row.

    ids are the text's tokens, special tokens never; slice_tokens counts the
    tokens of each pre-token and slice_offsets is its first byte in the UTF-8
    text, so any token range decodes in place.  Null and empty texts have no
    tokens.  Ids may be null or repeated; other columns are not read.
    """
    spark = docs.sparkSession
    cluster.ship(spark)
    ranks = spark.sparkContext.broadcast(_read(ranks_path))  # a vocabulary file

    def run(batches):
        own = coder(ranks.value)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            ids, counts, offsets = [], [], []
            for _, entry, cut, at in own.encode(texts):
                for i in range(len(cut) - 1):
                    e = entry[cut[i] : cut[i + 1]].tolist()
                    ids.append(np.concatenate([own.ids[k] for k in e]) if e else np.zeros(0, np.int32))
                    counts.append(np.array([len(own.ids[k]) for k in e], np.int32))
                    offsets.append(at[cut[i] : cut[i + 1]].astype(np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, counts, offsets)]
            yield pa.RecordBatch.from_arrays([batch["id"], *lists], ["id", "ids", "slice_tokens", "slice_offsets"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(
        run, f"id {kind}, ids array<int>, slice_tokens array<int>, slice_offsets array<int>"
    )
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of ``encode`` with column text: the string of the ids' bytes; null ids give null."""
    spark = encoded.sparkSession
    cluster.ship(spark)
    ranks = spark.sparkContext.broadcast(_read(ranks_path))  # a vocabulary file
    names = encoded.columns

    def run(batches):
        own = coder(ranks.value).vocabulary
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "text"]
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, text string")


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): ``encode`` and decoding, without the ids' own columns.

    Hashes are lowercase hex: of the decimal ids joined by one space, and of
    the bytes the ids decode to.  A text without tokens hashes empty bytes.
    """
    spark = docs.sparkSession
    cluster.ship(spark)
    ranks = spark.sparkContext.broadcast(_read(ranks_path))  # a vocabulary file
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        own = coder(ranks.value)
        for batch in batches:
            n, ids, raw = [], [], []
            for _, entry, cut, _ in own.encode([t or "" for t in batch["text"].to_pylist()]):
                total = np.concatenate([[0], np.cumsum(own.sizes[entry])])[cut]
                n += np.diff(total).tolist()
                all_entries = entry.tolist()
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    e = all_entries[a:b]
                    ids.append(hashlib.sha256(b"".join([own.decimal[k] for k in e])[:-1]).hexdigest())
                    raw.append(hashlib.sha256(b"".join([own.raw[k] for k in e])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()

"""Local image descriptors: cropped and edited copies by matching corners.

Corners are found at several scales, oriented by their intensity centroid and
described by 256 binary tests in the turned frame.  Every corner that has room
for its descriptor is taken, so their number grows with the image.  Descriptors
meet in tables of 32-bit bands: two that differ in at most 7 bits are sure to
be equal in one of the 8.  Image pairs that meet once, in any of their corners,
are verified with all their descriptors, which match within 24 bits: where
enough corners have a match, the matches vote for a scale, turn and shift.  So a copy is missed only if no
corner of it keeps one band whole; the tests measure that for scaled, turned,
noisy and blurred copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster
from .kernels import ragged

SCALES = (1.0, 0.8, 0.64, 0.5)
RADIUS, MARGIN, TURNS = 14, 15, 32
BITS, BANDS = 256, 8
#: Bits by which matched descriptors may differ, corners that agree.
MAX_BITS, MIN_AGREE = 24, 4
#: What agrees: a step of the logarithm of scale, parts of a full turn, and pixels of shift.
SCALE_STEP, TURN_PARTS, SHIFT = 0.3, 18, 8
#: Corners, image pixels and pairs of descriptors that are held at once.
_CORNERS, _PIXELS, _MATCHES = 4096, 1 << 22, 1 << 18

_rng = np.random.default_rng(2024)
_disc = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
_PAIRS = _disc[_rng.integers(0, len(_disc), (BITS, 2))]  # (test, end, yx)
_angle = 2 * np.pi * np.arange(TURNS) / TURNS
_c, _s = np.cos(_angle)[:, None, None], np.sin(_angle)[:, None, None]
_TURNED = np.stack(
    [_PAIRS[..., 1] * _s + _PAIRS[..., 0] * _c, _PAIRS[..., 1] * _c - _PAIRS[..., 0] * _s], -1
).round().astype(int)  # (turn, test, end, yx)


def pgm(image: np.ndarray) -> bytes:
    """A grey image as binary PGM."""
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The grey image of a binary PGM with 8-bit samples; None for anything else."""
    head, _, body = (data or b"").partition(b"\n")
    parts = head.split()
    if len(parts) != 4 or parts[0] != b"P5" or parts[3] != b"255" or not (parts[1] + parts[2]).isdigit():
        return None
    w, h = int(parts[1]), int(parts[2])
    return np.frombuffer(body, np.uint8).reshape(h, w) if len(body) == w * h else None


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    for axis in (1, 2):
        n = x.shape[axis]
        at = np.clip((np.arange(int(n * scale)) + 0.5) / scale - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), n - 2) if n > 1 else np.zeros(len(at), int)
        f = (at - lo).astype(np.float32)
        f = f[None, :, None] if axis == 1 else f[None, None, :]
        x = np.take(x, lo, axis) * (1 - f) + np.take(x, np.minimum(lo + 1, n - 1), axis) * f
    return x


def _box(x: np.ndarray, r: int) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        total = np.cumsum(np.pad(x, pad, mode="edge"), axis)
        k = 2 * r + 1
        x = (np.take(total, range(k, total.shape[axis]), axis) - np.take(total, range(total.shape[axis] - k), axis)) / k
    return x


def describe(images: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each image of one shape (n, h, w): x, y, turn, scale and bits (32 bytes) of its corners."""
    found: list[list] = [[] for _ in images]
    for scale in SCALES:
        x = _resize(images.astype(np.float32), scale)
        if min(x.shape[1:]) <= 2 * MARGIN + 1:
            continue
        x = _box(x, 1)
        dy, dx = np.gradient(x, axis=1), np.gradient(x, axis=2)
        a, b, c = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[:, MARGIN:-MARGIN, MARGIN:-MARGIN]
        peak = inner > 1.0
        h, w = inner.shape[1:]
        for oy in (-1, 0, 1):
            for ox in (-1, 0, 1):
                if oy or ox:
                    near = r[:, MARGIN + oy : MARGIN + oy + h, MARGIN + ox : MARGIN + ox + w]
                    peak &= inner >= near if (oy, ox) < (0, 0) else inner > near
        every = np.nonzero(peak)
        for k in range(0, len(every[0]), _CORNERS):
            img, y, xx = (at[k : k + _CORNERS] for at in every)
            y, xx = y + MARGIN, xx + MARGIN
            near = x[img[:, None], y[:, None] + _disc[:, 0], xx[:, None] + _disc[:, 1]]
            angle = np.arctan2(near @ _disc[:, 0].astype(np.float32), near @ _disc[:, 1].astype(np.float32))
            turn = np.round(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
            points = _TURNED[turn]
            v = x[img[:, None, None], y[:, None, None] + points[..., 0], xx[:, None, None] + points[..., 1]]
            bits = np.packbits(v[..., 0] + 1e-3 < v[..., 1], axis=1)
            for i, px, py, t, d in zip(img.tolist(), xx, y, angle, bits, strict=True):
                found[i].append(((px + 0.5) / scale, (py + 0.5) / scale, t, scale, d))
    out = []
    for rows in found:
        numbers = np.array([r[:4] for r in rows], np.float32).reshape(-1, 4)
        bits = np.array([r[4] for r in rows], np.uint8).reshape(-1, BITS // 8)
        out.append({"numbers": numbers, "bits": bits})
    return out


POINTS = "id long, bits binary, numbers binary"
FOUND = ["query_id", "image_id", "agreeing", "dx", "dy"]


def descriptors(media: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """(id, bits, numbers): packed descriptors of each row; none for what is no grey PGM."""
    cluster.ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            images = [read_pgm(x) for x in batch["image"].to_pylist()]
            got = [None] * len(images)
            shapes: dict[tuple, list[int]] = {}
            for i, x in enumerate(images):
                if x is not None:
                    shapes.setdefault(x.shape, []).append(i)
            for rows in shapes.values():
                step = max(1, min(128, _PIXELS // max(images[rows[0]].size, 1)))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    for i, d in zip(part, describe(np.stack([images[i] for i in part])), strict=True):
                        got[i] = d
            empty = {"numbers": np.zeros((0, 4), np.float32), "bits": np.zeros((0, BITS // 8), np.uint8)}
            got = [g or empty for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    pa.array([g["bits"].tobytes() for g in got], pa.binary()),
                    pa.array([g["numbers"].tobytes() for g in got], pa.binary()),
                ],
                ["id", "bits", "numbers"],
            )

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image")).mapInArrow(run, POINTS)


def band_rows(points: DataFrame) -> DataFrame:
    """(id, band) once for each image and band: a band is its number and 32 bits of one descriptor in a long."""

    def run(batches):
        for batch in batches:
            ids, bands = [], []
            for i, bits in zip(batch["id"].to_pylist(), batch["bits"].to_pylist(), strict=True):
                v = np.frombuffer(bits, "<u4").reshape(-1, BANDS).astype(np.int64)
                bands.append(np.unique(v + (np.arange(BANDS, dtype=np.int64) << 32)))
                ids.append(np.full(len(bands[-1]), i, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(bands))], ["id", "band"])

    return points.select("id", "bits").mapInArrow(run, "id long, band long")


def band_lists(asked: DataFrame) -> DataFrame:
    """(list, queries, bands): queries that share bands, once for all the bands that just they have; list is the least of those."""
    queries = F.array_sort(F.collect_list("id")).alias("queries")
    shared = band_rows(asked).groupBy("band").agg(queries)
    return shared.groupBy("queries").agg(F.collect_list("band").alias("bands")).select(F.array_min("bands").alias("list"), "queries", "bands")


def meeting(lists: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, id) once for each query and image that share a band.

    A band of an image meets one list at most, and an image that has many of a
    list's bands has the list once, so a group of near copies is not joined
    band by band with each of its queries.
    """
    met = band_rows(points).join(lists.select(F.explode("bands").alias("band"), "list"), "band").select("id", "list").distinct()
    return met.join(lists.select("list", "queries"), "list").select(F.explode("queries").alias("query_id"), "id").distinct()


def _enough(bits_a: bytes, bits_b: bytes) -> bool:
    """Whether MIN_AGREE descriptors of the first are within MAX_BITS of any of the second: with fewer no votes suffice."""
    a, b = (np.frombuffer(x, "<u8").reshape(-1, BITS // 64) for x in (bits_a, bits_b))
    met, step = 0, max(1, _MATCHES // max(len(b), 1))
    for k in range(0, len(a), step):
        apart = np.bitwise_count(a[k : k + step, None] ^ b[None]).sum(2, dtype=np.uint16)
        met += int((apart <= MAX_BITS).any(1).sum())
        if met >= MIN_AGREE:
            return True
    return False


def _near(a: np.ndarray, b: np.ndarray):
    """Indexes of descriptors within MAX_BITS of each other, some at a time; equal ones are compared once."""
    ua, ia = np.unique(a, axis=0, return_inverse=True)
    ub, ib = np.unique(b, axis=0, return_inverse=True)
    rows_a, rows_b = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    na, nb = np.bincount(ia, minlength=len(ua)), np.bincount(ib, minlength=len(ub))
    fa, fb = np.cumsum(na) - na, np.cumsum(nb) - nb
    step = max(1, _MATCHES // len(ub))
    for k in range(0, len(ua), step):
        x, y = np.nonzero(np.bitwise_count(ua[k : k + step, None] ^ ub[None]).sum(2) <= MAX_BITS)
        x += k
        upto = np.cumsum(na[x] * nb[y])
        for cut in np.split(np.arange(len(x)), np.searchsorted(upto, np.arange(_MATCHES, upto[-1] if len(upto) else 0, _MATCHES))):
            if len(cut):
                p, q = x[cut], y[cut]
                n = na[p] * nb[q]
                at = ragged(np.zeros(len(n), np.int64), n)
                width = np.repeat(nb[q], n)
                yield rows_a[np.repeat(fa[p], n) + at // width], rows_b[np.repeat(fb[q], n) + at % width]


def _bins(i: np.ndarray, step: np.ndarray, turn: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sixteen bins of each match, as numbers that end with its corner: the grids are half a bin apart, so what agrees shares one."""
    out = []
    for k in range(16):
        half = [(k >> b & 1) / 2 for b in range(4)]
        s = np.floor(step / SCALE_STEP + half[0]).astype(np.int64) + 32
        t = np.floor(turn / (2 * np.pi) * TURN_PARTS + half[1]).astype(np.int64) % TURN_PARTS
        u, v = (np.clip(np.floor(p / SHIFT + h).astype(np.int64) + (1 << 14), 0, (1 << 15) - 1) for p, h in ((x, half[2]), (y, half[3])))
        out.append((((((k << 6 | np.clip(s, 0, 63)) << 5 | t) << 15 | u) << 15 | v) << 17) | (i & 0x1FFFF))
    return np.concatenate(out)


def agreement(q_bits: bytes, q_numbers: bytes, bits: bytes, numbers: bytes) -> tuple[int, float, float]:
    """Corners of the first image whose matches agree on one scale, turn and shift, and that shift.

    Each match votes in a table of bins, so the work is linear in matches; a
    corner counts once in a bin, however many matches it has there.
    """
    a, b = (np.frombuffer(x, "<u8").reshape(-1, BITS // 64) for x in (q_bits, bits))
    na, nb = (np.frombuffer(x, np.float32).reshape(-1, 4).astype(np.float64) for x in (q_numbers, numbers))
    if not len(a) or not len(b):
        return 0, 0.0, 0.0
    middle = na[:, :2].mean(0)

    def placed(i, j):
        scale = na[i, 3] / nb[j, 3]
        turn = (nb[j, 2] - na[i, 2] + np.pi) % (2 * np.pi) - np.pi
        c, s = np.cos(turn) * scale, np.sin(turn) * scale
        dx, dy = (middle - na[i, :2]).T
        return np.log(scale), turn, nb[j, 0] + c * dx - s * dy, nb[j, 1] + s * dx + c * dy

    seen = np.zeros(0, np.int64)
    for i, j in _near(a, b):
        seen = np.union1d(seen, _bins(i, *placed(i, j)))
    if not len(seen):
        return 0, 0.0, 0.0
    bins, votes = np.unique(seen >> 17, return_counts=True)
    best = bins[np.argmax(votes)]
    shifts = []
    for i, j in _near(a, b):
        step, turn, x, y = placed(i, j)
        own = (_bins(i, step, turn, x, y) >> 17).reshape(16, -1) == best
        k = np.flatnonzero(own.any(0))
        shifts.append(np.stack([step[k], turn[k], x[k], y[k]]))
    step, turn, x, y = np.median(np.concatenate(shifts, 1), axis=1)
    turn = 0.0 if abs(turn) < 0.1 else turn
    c, s = np.cos(turn) * np.exp(step), np.sin(turn) * np.exp(step)
    return int(votes.max()), float(x - c * middle[0] + s * middle[1]), float(y - s * middle[0] - c * middle[1])


def find_copies(queries: DataFrame, media: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """(query_id, image_id, agreeing, dx, dy, class_size): images that a query is cropped or edited from.

    Both tables have an id and a grey image (binary PGM).  Equal images of
    media are one class: its least id stands for it and class_size counts its
    rows.  dx and dy place the query in the image, rounded to pixels.  Null,
    broken, flat and tiny images have no corners and match nothing; repeated
    rows only count in class_size; rows of a null id are left out.

    Every pair that meets in the band tables is verified, without a cap, and a
    pair that does not meet has no match within 7 bits.  A band that very many
    *different* images share costs a pair for each with each query that has it.
    """
    own = media.where(F.col(id_col).isNotNull())
    classes = (
        own.groupBy(F.sha2(F.col(image_col), 256).alias("hash"))
        .agg(F.min(id_col).alias("id"), F.count("*").alias("class_size"))
        .select(F.col("id").cast("long").alias("id"), "class_size")
    )
    scratch = cluster.Scratch(media.sparkSession)
    rep = own.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image")).join(classes, "id")
    points = scratch.write(descriptors(rep.dropDuplicates(["id"]), "id", "image"), "points")
    asked = scratch.write(
        descriptors(queries.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]), id_col, image_col), "asked"
    )
    pairs = meeting(scratch.write(band_lists(asked), "lists"), points).join(asked.select(F.col("id").alias("query_id"), F.col("bits").alias("q_bits"), F.col("numbers").alias("q_numbers")), "query_id").join(points, "id")

    def verify(batches):
        for batch in batches:
            rows = []
            for q, i, *both in zip(*(batch[c].to_pylist() for c in ("query_id", "id", "q_bits", "q_numbers", "bits", "numbers")), strict=True):
                votes, dx, dy = agreement(*both) if _enough(both[0], both[2]) else (0, 0.0, 0.0)
                if votes >= MIN_AGREE:
                    rows.append((q, i, votes, round(dx), round(dy)))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], FOUND)

    found = pairs.mapInArrow(verify, "query_id long, image_id long, agreeing int, dx int, dy int")
    return found.join(classes.withColumnRenamed("id", "image_id"), "image_id").select(
        "query_id", "image_id", "agreeing", "dx", "dy", "class_size"
    )


def best_copies(queries: DataFrame, media: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """(query_id, image_id, agreeing, dx, dy, class_size, n_classes, n_images): a row for each query of an id.

    Of the classes that ``find_copies`` finds, the one with most agreeing
    corners, then the least id, stands in the row (nulls without one);
    n_classes counts all of them and n_images their rows.
    """
    found = find_copies(queries, media, id_col, image_col)
    best = found.groupBy("query_id").agg(
        F.min(F.struct((-F.col("agreeing")).alias("order"), "image_id", "agreeing", "dx", "dy", "class_size")).alias("b"),
        F.count("*").alias("n_classes"),
        F.sum("class_size").alias("n_images"),
    )
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return asked.join(best, "query_id", "left").select(
        "query_id", "b.image_id", "b.agreeing", "b.dx", "b.dy", "b.class_size", zero("n_classes"), zero("n_images")
    )


def tiles(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(image_id, image): each vector drawn as 8 by 8 grey tiles of 8 pixels; missing values are mid-grey."""
    cluster.ship(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            images = []
            for v in batch["v"].to_pylist():
                x = np.zeros(64)
                got = [np.nan if t is None else t for t in (v or [])[:64]]
                x[: len(got)] = np.nan_to_num(np.array(got, float))
                grey = np.clip(127.5 + 300 * x, 0, 255).round().reshape(8, 8)
                images.append(pgm(np.kron(grey, np.ones((8, 8)))))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(images, pa.binary())], ["image_id", "image"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, "image_id long, image binary")


def edited(media: DataFrame, side: int = 52) -> DataFrame:
    """A crop of ``side`` pixels of each image, at a place that its id decides, darkened and lifted."""

    def run(batches):
        for batch in batches:
            out = []
            for i, data in zip(batch["image_id"].to_pylist(), batch["image"].to_pylist(), strict=True):
                x = read_pgm(data)
                if x is not None:
                    h, w = max(x.shape[0] - side, 0), max(x.shape[1] - side, 0)
                    y0, x0 = (i * 5 // 50) % (h + 1), (i * 7 // 50) % (w + 1)
                    x = pgm(np.round(x[y0 : y0 + side, x0 : x0 + side] * 0.85 + 12))
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch["image_id"], pa.array(out, pa.binary())], ["image_id", "image"])

    return media.select("image_id", "image").mapInArrow(run, "image_id long, image binary")

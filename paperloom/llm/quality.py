"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A labelled document of quality 1 is preferred to one of quality 0.  The model
says P(a beats b) = sigmoid(w . (x_a - x_b)); w minimises the logistic loss of
feature differences.  The cut is the score quantile at the labelled share of
quality 0, and scores are shifted so that this cut is ``CUT``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster
from . import kernels as K

#: Labelled rows that the fit reads at most, the first by a hash of their id, and pairs made of them.
SAMPLE, PAIRS, SEED = 8_000, 60_000, 17
CUT, L2, CLIP = 0.7, 1e-3, 4.0

_CLASSES = {
    "upper": [(0x41, 0x5A)],
    "lower": [(0x61, 0x7A)],
    "digit": [(0x30, 0x39)],
    "symbol": [(c, c) for c in b"#*$%&|<>{}[]@\\^~=_+"],
    "loud": [(0x21, 0x21), (0x3F, 0x3F)],
    "stop": [(c, c) for c in b".,;:'\"()-"],
    "high": [(0x80, 0xFF)],
    "line": [(0x0A, 0x0A)],
}
FEATURES = (
    "log_words", "mean_word", "long_words", "short_words", "upper", "lower", "digit", "symbol", "loud", "stop", "high",
    "line", "distinct_words", "top_pairs", "repeat_next", "distinct_windows", "marked_words",
)
_TABLES = {}
for _name, _spans in _CLASSES.items():
    _TABLES[_name] = np.zeros(256, bool)
    for _a, _b in _spans:
        _TABLES[_name][_a : _b + 1] = True


def _per_text(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[cut[1:]] - total[cut[:-1]]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each text."""
    order = np.argsort(K.mix(h ^ K.mix(doc.astype(np.uint64))))
    d, h = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[new], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text, from its whole bytes; zeros for null and blank texts."""
    out = [np.zeros((0, len(FEATURES)))]
    for _, data, off in K.chunks(texts):
        s, e, fw = K.words(data, off)
        n = len(off) - 1
        words = np.diff(fw)
        size = np.maximum(np.diff(off) - 1, 1)
        some = np.maximum(words, 1)
        doc = np.repeat(np.arange(n), words)
        length = e - s
        h = K.slice_hash(data, s, e)
        col = {"log_words": np.log1p(words), "mean_word": _per_text(length, fw) / some}
        col["long_words"] = _per_text(length >= 12, fw) / some
        col["short_words"] = _per_text(length <= 3, fw) / some
        for name, flags in _TABLES.items():
            col[name] = _per_text(flags[data], off) / size
        col["line"] = col["line"] - 1 / size
        col["distinct_words"] = _distinct(doc, h, n) / some
        same_doc = doc[1:] == doc[:-1]
        col["repeat_next"] = np.bincount(doc[1:][same_doc & (h[1:] == h[:-1])], minlength=n) / some
        for name, k in (("top_pairs", 2), ("distinct_windows", 5)):
            place, of = K.within(fw, k)
            w = K.windows(h, k, 40 + k)[place]
            col[name] = _distinct(of, w, n) / np.maximum(words - k + 1, 1)
        odd = _TABLES["symbol"] | _TABLES["loud"]
        col["marked_words"] = _per_text(odd[data[e - 1]], fw) / some
        rows = np.stack([col[f] for f in FEATURES], 1)
        rows[words == 0] = 0
        out.append(rows)
    return np.concatenate(out)


def _basis(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    return np.concatenate([z, z * z], 1)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> dict:
    """Weights, scaling and cut from features and labels (1 preferred to 0); without both labels, all weights are 0."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    model = {"mean": mean.tolist(), "scale": scale.tolist(), "w": [0.0] * (2 * len(FEATURES)), "cut": 0.0}
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    b = _basis(x, mean, scale)
    rng = np.random.default_rng(seed)
    d = b[rng.choice(good, pairs)] - b[bad[np.arange(pairs) % len(bad)]]
    w = np.zeros(d.shape[1])
    for _ in range(12):  # Newton's steps on the mean logistic loss of differences
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + L2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + L2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    u = np.sort(b @ w)
    k = len(bad)  # the quantile between the k-th lowest score and the next
    cut = (u[k - 1] + u[min(k, len(u) - 1)]) / 2
    return model | {"w": w.tolist(), "cut": float(cut)}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    u = _basis(x, np.array(model["mean"]), np.array(model["scale"])) @ np.array(model["w"]) - model["cut"]
    return 1 / (1 + np.exp(-np.clip(u + np.log(CUT / (1 - CUT)), -500, 500)))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from at most ``sample`` labelled rows that are not held out.

    A label counts where it is 0 or 1; of several for an id the lowest holds,
    and of several texts of an id the one with the least features.
    """
    spark = docs.sparkSession
    cluster.ship(spark)
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min("quality").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")

    def run(batches):
        for batch in batches:
            x = features(batch["text"])
            lists = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], lists], ["id", "y", "x"])

    got = rows.select("id", F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "id long, y int, x array<double>")
    got = got.groupBy("id", "y").agg(F.min("x").alias("x"))  # one row an id: no more than the sample
    got = got.toPandas().sort_values("id", kind="stable")
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy())


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input columns and held_out, score (0 to 1) and predicted (1 where score >= 0.7).

    Only the text enters a score; null and empty texts score like texts
    without words.  Repeated rows score alike; a null id is not held out.
    Input columns of the added names are replaced.
    """
    spark = docs.sparkSession
    cluster.ship(spark)
    docs = docs.drop("held_out", "score", "predicted")
    names = docs.columns
    text = json.dumps(model)

    def run(batches):
        m = json.loads(text)
        for batch in batches:
            y = score(m, features(batch[text_col]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    out = docs.mapInArrow(run, f"{schema}, score double")
    return out.withColumns(
        {"held_out": held_out(id_col), "predicted": (F.col("score") >= CUT).cast("int")}
    ).select(*names, "held_out", "score", "predicted")

"""Importance resampling towards a target distribution by hashed n-gram gains, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster, ranks

#: All but digits, ASCII letters and what is not ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N_MAX, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; none for null."""
    raw = F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")
    # lower() would also change letters beyond ASCII; where there are none it is the quicker way.
    return F.transform(raw, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def ngrams(words: Column, n_max: int) -> Column:
    """All runs of 1 to n_max consecutive words, joined by one space."""
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

    return F.concat(words, *[runs(n) for n in range(2, n_max + 1)])


def _bucketed(rows: DataFrame, text_col: str, n_max: int, buckets: int, *keep: Column) -> DataFrame:
    """keep, n_words and the bucket of each feature, for each row."""
    made = rows.select(*keep, words_of(F.col(text_col)).alias("_pl_words"))
    hashed = F.transform(ngrams(F.col("_pl_words"), n_max), lambda g: (F.crc32(g) % buckets).cast("int"))
    kept = [c for c in made.columns if c != "_pl_words"]
    return made.select(*kept, F.size("_pl_words").cast("long").alias("n_words"), hashed.alias("buckets"))


def _counts(bucketed: DataFrame, name: str) -> DataFrame:
    return bucketed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, of rows with an array column ``buckets``.

    gain is floor(1000 ln(p / q)) with p and q the add-one smoothed shares of
    the bucket among the features of target and raw.
    """
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_counts(raw, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    all_ = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda name, more: F.col(name).cast("double") + float(more)
    ratio = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return both.crossJoin(F.broadcast(all_)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row of totals


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("<seed>:<id>"); a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    n_max: int = N_MAX,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(id_col, n_features, weight, score, rank), all long, for each row of docs.

    A text's features are its word runs of 1 to n_max, hashed into buckets.
    weight is the floored mean gain of its features (0 without any), score
    adds a Gumbel perturbation that the id gives, so the highest scores are a
    draw without replacement by weight.  rank counts from 1 down the drawn
    rows: floor(percent / 100) of those with min_words words, by score, ties
    to the smaller id; the others' rank is null.  Null and empty texts have no
    features and are not drawn.  Rows of a null id share one perturbation and
    come last among equals; repeated rows are rows of their own.  Other
    columns are not read.  Without target features all gains come from the
    smoothing.  An empty table gives an empty one.

    Plan: one scan of the texts writes bucket numbers; counts by bucket are
    summed before they are shuffled; the gain table, a row for each bucket, is
    broadcast; scores are ranged and ranked from the totals of ranges.
    """
    spark = docs.sparkSession
    scratch = cluster.Scratch(spark)
    own = [F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")]
    seen = scratch.write(_bucketed(docs, text_col, n_max, buckets, *own), "seen")
    gain = scratch.write(gains(seen, _bucketed(target, target_text, n_max, buckets), buckets), "gain")
    summed = (
        seen.select("row", "id", "n_words", F.explode_outer("buckets").alias("bucket"))
        .join(F.broadcast(gain), "bucket", "left")  # a row for each of a fixed number of buckets
        .groupBy("row", "id", "n_words")
        .agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    )
    weight = F.expr("(total - pmod(total, greatest(n_features, 1))) div greatest(n_features, 1)")
    scored = scratch.write(
        summed.select(
            "id",
            "n_features",
            weight.alias("weight"),
            (weight + gumbel(F.col("id"), seed)).alias("score"),
            (F.col("n_words") >= min_words).alias("able"),
        ),
        "scored",
    )
    scratch.keep_only("scored")
    drawn = percent * scored.where("able").count() // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("id")]
    placed = ranks.numbered(scored, order, scratch, "ranked")
    rank = F.when(F.col(ranks.AT) < drawn, F.col(ranks.AT) + 1).cast("long")
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))

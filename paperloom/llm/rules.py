"""Quality rules: cross-document line frequency and per-text base metrics, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A line goes where more documents of its host hold it than the least of these: a count with a share for
#: small hosts, the same for large ones, and a count for any.
SMALL, LARGE, ANY = (5, 0.1), (50, 0.01), 1000
#: A document is depleted when less than this share of its words stays.
MIN_KEPT_SHARE = 0.2
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def base_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); needs no shuffle.

    Null, empty and blank texts have zeros.  3-word windows are told apart by
    a 64-bit hash within their text, whatever its length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumns({"_pl_words": words_of(F.col(text_col)), "_pl_lines": lines})
    words, n = F.col("_pl_words"), F.size("_pl_words")
    grams = F.transform(
        F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))
    )
    none = F.array().cast("array<bigint>")
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.size(F.split(text, f"[{SYMBOLS}]")) - 1).cast("long"),
            "n_dup_lines": (F.size("_pl_lines") - F.size(F.array_distinct("_pl_lines"))).cast("long"),
            "_pl_grams": F.when(n >= 3, grams).otherwise(none),
        }
    ).drop("_pl_words", "_pl_lines")
    # Most texts repeat no window: only the others are sorted.
    g = F.col("_pl_grams")
    placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_pl_sorted", F.when(F.size(F.array_distinct(g)) < F.size(g), placed)).drop("_pl_grams")
    s = F.col("_pl_sorted")
    hit = F.filter(
        s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | ((k < F.size(s) - 1) & (x["h"] == F.get(s, k + 1)["h"]))
    )
    cover = F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return out.withColumn("n_repeat_words", F.coalesce(F.size(cover), F.lit(0)).cast("long")).drop("_pl_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def normal_line(line: Column) -> Column:
    """A line for comparison: lower case, single spaces; digits stay, as they may be all that tells two lines apart."""
    return F.trim(F.regexp_replace(F.lower(line), BLANK, " "))


def line_limit(documents: Column, small: tuple = SMALL, large: tuple = LARGE, any_host: int = ANY) -> Column:
    """Documents of a host that may hold a line, for a host of so many."""
    count, share = zip(small, large, strict=True)
    return F.least(*[F.greatest(F.lit(float(c)), documents * p) for c, p in zip(count, share, strict=True)], F.lit(float(any_host)))


def _keys(id_col: str, text_col: str, host_col: str) -> dict[str, Column]:
    """Two hashes that name a row: equal rows have equal ones and are judged alike."""
    own = [x for c in (id_col, host_col, text_col) for x in (F.col(c).cast("string"), F.col(c).isNull())]
    return {"_pl_1": F.xxhash64(*own), "_pl_2": F.xxhash64(F.lit(1), *own[::-1])}


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits
) -> DataFrame:
    """A row for each row of docs: _pl_1, _pl_2, id_col, the base metrics, n_left, n_cut_lines, base_failed, kept, _pl_cut.

    Lines are normalised and hashed; a row is one document, and counts once
    for a line however often it holds it.  A line of more documents of its
    host than ``line_limit`` allows is cut: _pl_cut holds the hashes of a
    document's cut lines, null for none.  Rules as in ``quality_rules``.

    Plan: one scan of the texts writes metrics and line hashes; counts by
    (host, line) and the cut lines' words come from that small table.
    """
    rows = docs.select(
        F.col(id_col).alias("_pl_id"), F.col(text_col).alias("_pl_text"), F.col(host_col).alias("_pl_host"), *[c.alias(n) for n, c in _keys(id_col, text_col, host_col).items()]
    )
    rows = cluster.spread(rows)
    line = lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(words_of(x)).alias("w"))
    lines = F.filter(F.transform(F.split(F.coalesce("_pl_text", F.lit("")), "\n"), line), lambda x: x["w"] > 0)
    seen = base_metrics(rows.withColumn("_pl_lines_h", lines), "_pl_text").drop("_pl_text")
    seen = cluster.Scratch(docs.sparkSession).write(seen, "seen")
    hosts = seen.groupBy("_pl_host").agg(line_limit(F.count("*"), **limits).alias("most"))
    held = (
        seen.select("_pl_host", F.explode(F.array_distinct(F.transform("_pl_lines_h", lambda x: x["h"]))).alias("h"))
        .groupBy("_pl_host", "h")
        .agg(F.count("*").alias("held"))
    )
    common = (
        held.join(hosts.withColumnRenamed("_pl_host", "_pl_of"), F.col("_pl_host").eqNullSafe(F.col("_pl_of")))
        .where("held > most")
        .select(F.col("_pl_host").alias("_pl_of"), F.col("h").alias("_pl_h"))
    )
    hit = (
        seen.select("_pl_1", "_pl_2", "_pl_host", F.posexplode("_pl_lines_h").alias("at", "e"))
        .select("_pl_1", "_pl_2", "_pl_host", "at", "e.h", "e.w")
        .join(common, F.col("_pl_host").eqNullSafe(F.col("_pl_of")) & (F.col("h") == F.col("_pl_h")))
        .select("_pl_1", "_pl_2", "at", "h", "w")
        .distinct()  # repeated rows have one key
        .groupBy("_pl_1", "_pl_2")
        .agg(F.sum("w").alias("_pl_gone"), F.count("*").alias("_pl_lines"), F.collect_set("h").alias("_pl_cut"))
    )
    return (
        seen.join(hit, ["_pl_1", "_pl_2"], "left")
        .withColumn("n_left", F.col("n_words") - F.coalesce("_pl_gone", F.lit(0)))
        .withColumn("n_cut_lines", F.coalesce("_pl_lines", F.lit(0)))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= MIN_KEPT_SHARE * F.col("n_words")))
        .select("_pl_1", "_pl_2", F.col("_pl_id").alias(id_col), *METRICS, "n_left", "n_cut_lines", "base_failed", "kept", "_pl_cut")
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits
) -> DataFrame:
    """The input columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left, base_failed, kept, clean_text.

    A document fails the base rules with fewer than 50 words, or with more
    than half of them in repeated 3-word windows.  Of the others, a document
    is rejected when under ``MIN_KEPT_SHARE`` of its words are left in
    clean_text, the text without its host's over-frequent lines (see
    ``judged``); n_left counts those words.  Null and blank texts have no
    words and fail.  A null host is a host of its own; null ids and repeated
    rows are judged like any other row, and repeated rows alike, each a
    document.  Input columns of the added names are replaced.
    """
    added = (*METRICS, "n_left", "base_failed", "kept", "clean_text")
    docs = docs.drop(*added)
    found = judged(docs, id_col, text_col, host_col, **limits).drop(id_col).dropDuplicates(["_pl_1", "_pl_2"])
    rest = F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains("_pl_cut", F.xxhash64(normal_line(x))))
    return (
        docs.withColumns(_keys(id_col, text_col, host_col))
        .join(found, ["_pl_1", "_pl_2"])
        .withColumn("clean_text", F.when(F.col("_pl_cut").isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n")))
        .select(*docs.columns, *added)
    )

"""Search: phrase, closed values, relations and tombstones, then order and page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import _FOLD, fold

CURSOR = "tpq1."
K1, B = 1.2, 0.75
#: Bytes of text whose entries are one sorted run, and entries that leave Python at a time.
RUN_BYTES, OUT_ROWS = 1 << 23, 1 << 16


def token_text(col: Column) -> Column:
    """Folded tokens of a text between single spaces, with a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def phrase_in(fields: Sequence[Column], phrase: str) -> Column | None:
    """Whether one field holds the phrase's tokens in a row; None for a blank phrase (no filter)."""
    if not phrase.strip():
        return None
    wanted = token_text(F.lit(phrase))
    out = F.lit(False)
    for field in fields:
        out = out | F.contains(token_text(field), wanted)
    return out & (wanted != "  ")


def deleted_filter(mode: str, deleted_at: Column) -> Column:
    return {"exclude": deleted_at.isNull(), "include": F.lit(True), "only": deleted_at.isNotNull()}[mode]


def any_of(values: Column, wanted: Sequence[str]) -> Column:
    """Whether a list column shares a value with the trimmed, non-blank wanted ones; no wanted value is no filter."""
    wanted = [w.strip() for w in wanted if w.strip()]
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def decode_cursor(cursor: str | None) -> int:
    if cursor is None:
        return 0
    if not re.fullmatch(re.escape(CURSOR) + r"\d+", cursor):
        raise ValueError("invalid cursor")
    return int(cursor[len(CURSOR) :])


def encode_cursor(offset: int) -> str:
    return f"{CURSOR}{offset}"


def page(rows: DataFrame, order: Sequence[Column], limit: int = 50, cursor: str | None = None) -> DataFrame:
    """One row more than the page (1 to 100), to tell whether another follows; order must end in a unique key."""
    n = min(max(limit, 1), 100)
    return rows.orderBy(*order).offset(decode_cursor(cursor)).limit(n + 1)


def search(
    bank: DataFrame,
    phrase: str = "",
    fields: Sequence[str] = ("text",),
    values: Mapping[str, Sequence[str]] | None = None,
    relations: Mapping[str, Sequence[str]] | None = None,
    deleted: str = "exclude",
) -> DataFrame:
    """Rows that pass all filters; values is column IN (none: no filter), relations is any-of on list columns."""
    if "deleted_at" in bank.columns:
        bank = bank.where(deleted_filter(deleted, F.col("deleted_at")))
    for name, allowed in (values or {}).items():
        if allowed:
            bank = bank.where(F.col(name).isin(*allowed))
    for name, wanted in (relations or {}).items():
        bank = bank.where(any_of(F.col(name), wanted))
    hit = phrase_in([F.col(f) for f in fields], phrase)
    return bank if hit is None else bank.where(hit)


def document_fields(subjects: str | None = "subjects", tags: str | None = "tags", source: str | None = "source") -> dict[str, Column]:
    """The searched fields of a question: text, source, and its subjects and tags each joined by a space; null is empty."""
    out = {"text": F.coalesce("text", F.lit(""))}
    if source:
        out["source"] = F.coalesce(source, F.lit(""))
    for name in (subjects, tags):
        if name:
            out[name] = F.coalesce(F.array_join(name, " "), F.lit(""))
    return out


def _entries(run_bytes: int, out_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of ``index`` in Arrow batches; its parts are inside, so that workers need not import this package."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """One run: tokens as numbers in their order, sorted by (token, row, field), where equal ones are one entry."""
        n, fields = rows.num_rows, rows.num_columns - 1
        tokens, row, place, sizes = [], [], [], np.zeros(n, np.int64)
        for k in range(fields):
            lists = pc.split_pattern(rows.column(k + 1).combine_chunks(), " ")
            count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten()
            at, begin = np.repeat(np.arange(n), count), np.repeat(np.cumsum(count) - count, count)
            some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # a text without tokens is one empty word
            tokens.append(words.filter(pa.array(some)))
            row.append((at * fields + k)[some])
            place.append((np.arange(len(words)) - begin)[some])
            sizes += np.bincount(at[some], minlength=n)
        coded = pa.chunked_array(tokens, pa.string()).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        names = coded.dictionary
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        code = coded.indices.to_numpy(zero_copy_only=False)
        key = rank[code] * (n * fields) + np.concatenate(row)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        at, field = np.divmod(key[first] % (n * fields), fields)
        empty = np.flatnonzero(sizes == 0)
        places = pa.ListArray.from_arrays(
            pa.array(np.concatenate([first, np.full(len(empty) + 1, len(key))]), pa.int32()), pa.array(np.concatenate(place)[order], pa.int32())
        )
        at, field = np.concatenate([at, empty]), np.concatenate([field, np.zeros(len(empty), np.int64)])
        token = pa.concat_arrays([names.take(pa.array(code[order[first]])), pa.nulls(len(empty), pa.string())])
        made = [token, rows.column(0).combine_chunks().take(pa.array(at)), pa.array(field, pa.int32()), pa.array(sizes[at], pa.int32()), places]
        out = pa.RecordBatch.from_arrays(made, ["token", "id", "field", "size", "places"])
        for i in range(0, out.num_rows, out_rows):
            yield out.slice(i, out_rows)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of rows (id, a text of single-spaced tokens for each field), in runs sorted by token.

        A run is the entries of ``RUN_BYTES`` of text or a little more, so a task's memory does not grow with its rows.
        """
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # Rows' ends within the batch, all fields and 16 bytes more: a part ends where it fills the run.
                ends = np.cumsum(16 + sum(pc.binary_length(c).to_numpy(zero_copy_only=False)[at:].astype(np.int64) for c in batch.columns[1:]))
                n = min(int(np.searchsorted(ends, run_bytes - size)) + 1, batch.num_rows - at)
                held.append(batch.slice(at, n))
                at, size = at + n, size + int(ends[n - 1])
                if size >= run_bytes:
                    yield from run(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield from run(pa.Table.from_batches(held))

    return runs


def index(bank: DataFrame, id_col: str, fields: Mapping[str, Column]) -> DataFrame:
    """(token, id, field, size, places): where each token stands in each field, with the row's tokens in all fields.

    A row without tokens has one entry, of a null token, so that statistics count it.
    A task gives its rows' entries in long runs sorted by token; no token
    leaves its task.  Written so, or sorted through (``write_index``), a search
    reads only the row groups and pages of its phrase's tokens.  A common token
    has a row for each document.
    """
    texts = [F.trim(token_text(c)).alias(f"f{k}") for k, c in enumerate(fields.values())]
    kind = bank.select(F.col(id_col)).dtypes[0][1]
    return bank.select(F.col(id_col).alias("id"), *texts).mapInArrow(_entries(RUN_BYTES, OUT_ROWS), f"token string, id {kind}, field int, size int, places array<int>")


def write_index(found: DataFrame, path: str) -> None:
    """The index by ranges of (token, id), so that hot tokens span files and rare ones share one."""
    found.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(path)


def phrase_tokens(phrase: str) -> list[str]:
    """The folded tokens of a phrase, in order."""
    low = "".join(_FOLD.get(c, c) for c in phrase.lower())
    return [t for t in re.split(r"[\W_]+", low) if t]


def index_hits(found: DataFrame, phrase: str, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, size, hits): rows of an index that hold the phrase in one field, and how often over all fields.

    ``also`` filters the entries of the phrase's tokens further.
    """
    at: dict[str, list[int]] = {}
    for k, t in enumerate(phrase_tokens(phrase)):
        at.setdefault(t, []).append(k)
    offsets = F.create_map(*[x for t, ks in at.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))]) if at else F.lit(None)
    if not at:
        return found.where(F.lit(False)).select("id", "size", F.lit(0).cast("long").alias("hits"))
    begins = F.flatten(F.transform("places", lambda p: F.transform(offsets[F.col("token")], lambda k: p - k)))
    entries = found.where(F.col("token").isin(*at))
    entries = also(entries) if also else entries
    # Dealt by id once, so that both steps below stay in the task that has a row's entries.
    return (
        entries.select("id", "size", "field", "token", "places").repartition("id")
        .select("id", "size", "field", F.explode(begins).alias("begin"))
        .groupBy("id", "size", "field", "begin")
        .count()
        .where(F.col("count") == sum(map(len, at.values())))
        .groupBy("id", "size")
        .agg(F.count("*").alias("hits"))
    )


def scan_hits(bank: DataFrame, id_col: str, fields: Mapping[str, Column], phrase: str) -> DataFrame:
    """(id, size, hits) for every row of a bank without an index, in one scan; hits is 0 where the phrase is not."""
    tokens = phrase_tokens(phrase)
    gap, edge = r"[^\p{L}\p{N}]+", r"(?![\p{L}\p{N}])"
    # What follows the first token is looked ahead at, so that phrases may overlap.
    pattern = rf"(?<![\p{{L}}\p{{N}}]){tokens[0]}(?={''.join(gap + t for t in tokens[1:])}{edge})" if tokens else "$^"
    counts = [F.struct(F.regexp_count(fold(c), F.lit(pattern)).alias("hits"), F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+")).alias("size")) for c in fields.values()]
    total = lambda name: F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x[name]).alias(name)
    return bank.select(F.col(id_col).alias("id"), F.array(*counts).alias("_c")).select("id", total("size"), total("hits"))


def score_hits(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, score) of rows with hits; the lower the better, as of full-text engines that rank one phrase.

    score = -idf * hits * (K1 + 1) / (hits + K1 * (1 - B + B * size / mean size)), where idf is
    ln((N - n + 0.5) / (n + 0.5)), or 0.000001 where that is not positive, N rows and n of them with hits.
    stats is one row (docs, mean_size, held): N, the mean size and n.
    """
    idf = F.log((F.col("docs") - F.col("held") + 0.5) / (F.col("held") + 0.5))
    joined = hits.where("hits > 0").crossJoin(F.broadcast(stats))  # one row of statistics
    f = F.col("hits")
    score = -F.when(idf > 0, idf).otherwise(1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    return joined.select("id", score.alias("score"))


def ranked(bank: DataFrame, id_col: str, fields: Mapping[str, Column], phrase: str, found: DataFrame | None = None) -> DataFrame:
    """Rows of the bank that hold the phrase, with their score; statistics are over the whole bank, filters come after.

    With an index (``found``) only the phrase's tokens are read for the hits.
    """
    if found is None:
        # Grouped by the unique id, so that one scan and one exchange of three small columns serve statistics and hits.
        hits = scan_hits(bank, id_col, fields, phrase).groupBy("id").agg(F.max("size").alias("size"), F.max("hits").alias("hits"))
        stats = hits.agg(F.count("*").alias("docs"), F.avg("size").alias("mean_size"), F.count_if(F.col("hits") > 0).alias("held"))
    else:
        hits = index_hits(found, phrase)
        sizes = found.groupBy("id").agg(F.first("size").alias("size"))
        stats = sizes.agg(F.count("*").alias("docs"), F.avg("size").alias("mean_size")).crossJoin(hits.agg(F.count("*").alias("held")))
    scored = score_hits(hits, stats)
    return bank.join(scored, bank[id_col] == scored["id"]).select(*[bank[c] for c in bank.columns], "score")


def bm25(bank: DataFrame, terms: Sequence[str], text_col: str = "text") -> DataFrame:
    """Rows that hold a term, with Okapi BM25 score (k1 1.2, b 0.75, idf ln(1 + (N - n + 0.5) / (n + 0.5)))."""
    folded = fold(F.coalesce(F.col(text_col), F.lit("")))
    terms = [token for t in terms for token in phrase_tokens(t)]
    count = lambda t: F.regexp_count(folded, F.lit(rf"(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])"))
    size = F.regexp_count(F.col(text_col), F.lit(r"[\p{L}\p{N}]+"))
    # An array of one, opened again: later steps read the counts and never repeat them.
    made = F.array(F.struct(F.coalesce(size, F.lit(0)).alias("_len"), *[count(t).alias(f"_tf{i}") for i, t in enumerate(terms)]))
    counted = bank.select("*", F.inline(made))
    names = [f"_tf{i}" for i in range(len(terms))]
    stats = counted.agg(
        F.count("*").alias("_n"),
        F.avg("_len").alias("_avg"),
        *[F.count_if(F.col(n) > 0).alias(f"_df{i}") for i, n in enumerate(names)],
    )
    held = reduce(lambda x, y: x | y, [F.col(n) > 0 for n in names])
    joined = counted.where(held).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i, n in enumerate(names):
        tf, df = F.col(n), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return joined.withColumn("score", score).select(*bank.columns, "score")

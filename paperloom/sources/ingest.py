"""Question import from CSV and JSON files: accepted rows, rejected rows with all their errors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import (
    DIFFICULTIES,
    QUESTION_TYPES,
    bounded_int,
    has_math,
    import_weight,
    parse_list,
    score_weight,
    tri_bool,
    trim_all,
)

#: Import fields and the headers that name them, first choice first.
FIELDS = {
    "type": ("type",),
    "difficulty": ("difficulty",),
    "subjects": ("subjects", "subject"),
    "tags": ("tags",),
    "text": ("text",),
    "options": ("options",),
    "answer": ("answer",),
    "weight": ("scoreWeight", "weight"),
    "latex": ("hasLatex", "latex"),
    "source": ("source",),
    "lines": ("essayLines", "lines"),
    "line_height": ("essayLineHeight", "lineHeight"),
}


#: Bytes of an import file at most.
MAX_BYTES = 64 << 20


def normalize_header(name: str) -> str:
    """camelCase of a header: blanks, - and _ go and raise the ASCII letter after them."""
    name = name.strip().lstrip("\ufeff")
    return re.sub(r"[-_\s]+([A-Za-z]?)", lambda m: m[1].upper(), name)


def _camel(header: Column) -> Column:
    """``normalize_header`` as an expression."""
    parts = F.split(F.regexp_replace(trim_all(header), "^\ufeff", ""), r"[-_\s]+")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def _cells(record: Column) -> Column:
    """The cells of a CSV record, quotes taken off."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',((?:[^",]++|"[^"]*+"?)*+)'), 1)
    return F.transform(
        raw, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    )


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, kind, error) of files below a path: kind is json or csv, error why a file is not imported."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.col("length") <= MAX_BYTES, F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")))
    rows = files.select(F.col("path").alias("file"), "length", text.alias("_t")).withColumn("value", trim_all(F.col("_t")))
    error = (
        F.when(F.col("length") > MAX_BYTES, f"Question import exceeds the {MAX_BYTES} byte limit.")
        .when(F.col("value").isNull(), "Question imports must be UTF-8 encoded.")
        .when(F.col("value") == "", "The selected file is empty.")
    )
    is_json = F.lower("file").endswith(".json") | F.col("value").rlike(r"^[\[{]")
    return rows.select("file", "value", F.when(is_json, "json").otherwise("csv").alias("kind"), error.alias("error"))


def read_import(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Import rows of all files below a path, as of ``csv_rows`` and ``json_rows``, and (file, error) of files that have none."""
    files = import_files(spark, path)
    good = files.where("error is null").select("file", "value", "kind")
    csv, js = good.where("kind = 'csv'"), good.where("kind = 'json'")
    headless = csv.where(~_has_header(F.col("value"))).select("file", F.lit("CSV import requires at least type and text columns.").alias("error"))
    invalid = js.where(F.try_parse_json("value").isNull()).select("file", F.lit("JSON import is invalid.").alias("error"))
    return csv_rows(csv).unionByName(json_rows(js)), files.where("error is not null").select("file", "error").union(headless).union(invalid)


# A CSV record up to its line's end; quoted line ends belong to it.
_RECORD = r'((?:[^"\r\n]++|"[^"]*+"?)++)(?:\r\n|\r|\n|$)'


def _has_header(text: Column) -> Column:
    names = F.transform(_cells(F.get(F.regexp_extract_all(text, F.lit(_RECORD), 1), F.lit(0))), _camel)
    return F.coalesce(F.array_contains(names, "type") & F.array_contains(names, "text"), F.lit(False))


def csv_rows(files: DataFrame) -> DataFrame:
    """(file, row_number, one string column a field) of whole CSV texts (file, value) with a header.

    Quoted newlines are kept, short records are padded and long ones cut.
    Records count from 2 with those that have only blank cells, which give no
    row; empty lines are no records.  Files whose header lacks type or text
    give none.
    """
    records = files.where(_has_header(F.col("value"))).select("file", F.regexp_extract_all("value", F.lit(_RECORD), 1).alias("r"))
    rows = records.select("file", F.transform(_cells(F.get("r", F.lit(0))), _camel).alias("names"), F.posexplode("r").alias("at", "record"))
    rows = rows.where("at > 0").select("file", (F.col("at") + 1).cast("long").alias("row_number"), "names", _cells(F.col("record")).alias("cells"))
    rows = rows.where(F.exists("cells", lambda c: trim_all(c) != ""))
    cell = lambda name: F.coalesce(F.get("cells", F.array_position("names", name).cast("int") - 1), F.lit(""))
    of = lambda headers: F.coalesce(*[F.when(F.array_contains("names", h), cell(h)) for h in headers])
    return rows.select("file", "row_number", *[of(headers).alias(f) for f, headers in FIELDS.items()])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """``csv_rows`` of CSV files."""
    return csv_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """``json_rows`` of JSON files."""
    return json_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def json_rows(texts: DataFrame) -> DataFrame:
    """(file, row_number from 1, one string column a field) of JSON arrays, bare or under ``questions``.

    Lists stay JSON text; an element that is no object has all fields null.
    """
    files = texts.select("file", F.try_parse_json("value").alias("v"))
    top = F.coalesce(F.try_variant_get("v", "$.questions", "variant"), F.col("v"))
    rows = files.select("file", top.alias("v")).lateralJoin(texts.sparkSession.tvf.variant_explode(F.col("v").outer()))
    rows = rows.select("file", (F.col("pos") + 1).cast("long").alias("row_number"), F.col("value").alias("v"))
    obj = F.from_json(F.to_json("v"), "map<string,string>")
    renamed = F.map_from_entries(
        F.transform(
            F.map_entries(obj),
            lambda e: F.struct(
                F.regexp_replace(F.initcap(F.regexp_replace(e["key"], "[-_ ]+", " ")), " ", "").alias("k"), e["value"].alias("v")
            ),
        )
    )
    # initcap lowers inner capitals, so headers are compared in lower case.
    lowered = F.transform_keys(renamed, lambda k, _: F.lower(k))
    rows = rows.withColumn("_m", F.when(F.to_json("v").startswith("{"), lowered))
    return rows.select(
        "file", "row_number", *[F.coalesce(*[F.col("_m")[h.lower()] for h in headers]).alias(f) for f, headers in FIELDS.items()]
    )


def validate(rows: DataFrame) -> DataFrame:
    """Import fields to question content and a sorted list of errors; accepted rows have none."""
    kind, level = trim_all(F.col("type")), trim_all(F.col("difficulty"))
    subjects, options = parse_list(F.col("subjects")), parse_list(F.col("options"))
    tags = F.array_distinct(F.transform(parse_list(F.col("tags")), F.lower))
    text = F.coalesce(trim_all(F.col("text")), F.lit(""))
    choice = kind.isin("single_choice", "multiple_choice", "true_false")
    options = F.when((kind == "true_false") & (F.size(options) == 0), F.array(F.lit("True"), F.lit("False"))).otherwise(options)
    answers = parse_list(F.col("answer"))
    plain = F.coalesce(trim_all(F.col("answer")), F.lit(""))
    listed = F.from_json("answer", "array<string>")
    answer = (
        F.when(kind == "multiple_choice", F.to_json(answers))
        .when(plain.startswith("[") & listed.isNotNull(), F.array_join(F.filter(F.transform(listed, trim_all), lambda x: x != ""), ", "))
        .otherwise(plain)
    )
    no_answer = F.when(kind == "multiple_choice", F.size(answers) == 0).otherwise(answer == "")
    known = F.coalesce(kind.isin(*QUESTION_TYPES), F.lit(False))
    known_level = F.coalesce(level.isin(*DIFFICULTIES), F.lit(False))
    both = known & known_level
    checks = [
        (~known, f"type must be one of {', '.join(QUESTION_TYPES)}"),
        (~known_level, "difficulty must be easy, medium, or hard"),
        (F.size(subjects) == 0, "subjects is required"),
        (text == "", "text is required"),
        (both & choice & (F.size(options) == 0), "options is required for choice and true/false questions"),
        (both & no_answer, "answer is required"),
    ]
    errors = F.array_sort(F.filter(F.array(*[F.when(bad, F.lit(m)) for bad, m in checks]), lambda e: e.isNotNull()))
    latex = has_math(text) | has_math(answer) | F.exists(options, has_math)
    essay = F.struct(
        bounded_int(F.col("lines"), 6, 1, 20).alias("lines"), bounded_int(F.col("line_height"), 28, 20, 48).alias("line_height")
    )
    return rows.select(
        "file",
        "row_number",
        kind.alias("type"),
        level.alias("difficulty"),
        subjects.alias("subjects"),
        tags.alias("tags"),
        text.alias("text"),
        F.when(choice, options).alias("options"),
        answer.alias("answer"),
        F.coalesce(tri_bool(F.col("latex")), latex).alias("has_latex"),
        F.nullif(trim_all(F.col("source")), F.lit("")).alias("source"),
        F.when(kind == "essay", essay).alias("essay_blank_space"),
        score_weight(import_weight(F.coalesce("weight", F.lit("1")))).alias("score_weight"),
        errors.alias("errors"),
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0).select("file", "row_number", "errors")


def counts(validated: DataFrame) -> DataFrame:
    """One row: how many rows are valid and invalid."""
    ok = F.size("errors") == 0
    return validated.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def commit(validated: DataFrame, to: str) -> dict[str, int]:
    """All rows in one write, which appears as a whole or not at all: accepted ones and, beside them, rejected ones with
    their errors, by the partition column ``accepted``.  Returns the numbers of valid and invalid rows."""
    ok = F.size("errors") == 0
    seen = Observation()
    rows = validated.withColumn("accepted", ok).observe(seen, F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))
    rows.write.mode("append").partitionBy("accepted").parquet(to)
    return seen.get


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, blob_hash, content) of files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("blob_hash"), "content")

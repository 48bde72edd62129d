"""From raw documents to packed training sequences, in five stages that each read what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import cluster, jaccard, packing, quality, rules, substring


def _with_text(docs: DataFrame, like: DataFrame, text: str) -> DataFrame:
    """The columns of ``like`` with another text, and n_chars of that text where the column is there."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in like.columns else {})
    return docs.withColumns(new).select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the lines over their host's limits go.

    Null, empty and blank texts are rejected; null hosts are one host; repeated rows are judged alike.
    """
    judged = rules.quality_rules(docs).where("kept").select(*docs.columns, "clean_text")
    return _with_text(judged, docs, "clean_text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the score cut go; labels are learned on the documents that the stage gets.

    Without labels of both kinds all scores are equal and at the cut, so all stay.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows one stays: that of the least id, ids before null, then the least text hash.

    Repeated ids and null ids are rows like others; texts without words link with nothing and stay.
    """
    made = docs.withColumn("_row", F.monotonically_increasing_id())
    made = cluster.Scratch(spark).write(made, "numbered")  # the numbers must not change between reads
    found = jaccard.jaccard_components(made, id_col="_row").select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row")
    first = made.select("_row", order.alias("o")).join(found, "_row").groupBy("component_id").agg(F.min("o").alias("o"))
    return made.join(first.select("o._row"), "_row", "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier in the corpus go; documents stay, some of them with an empty text."""
    return _with_text(substring.dedup_substrings(docs), docs, "text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens; null and empty texts are one token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Learned scores cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; what one keeps is written for the next, and dropped when that is written."""
    scratch = cluster.Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with cluster.passing():  # what a stage has written on its way goes when its rows are there
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep_only(name)
    return STAGES[-1][1](spark, docs, sf_dir)

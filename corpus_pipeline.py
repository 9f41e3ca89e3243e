"""The training-data pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return
the columns of documents. run() writes each stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packaudit.llm import exact_spans, kneser_ney, near_dedup, packing, rules
from packaudit.llm.common import packed, saved, stage_scratch, table, units
from packaudit.llm.queries import vocabulary


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(made: Stage) -> Stage:
    """A stage; when it begins, the scratch tables of the stages before it go."""

    @wraps(made)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_scratch(docs):
            return made(spark, docs, sf_dir)

    return run


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity is within their language's limit; empty and null texts go."""
    judged = kneser_ney.quality(docs, table(sf_dir, spark, "labels"))
    return packed(docs).join(judged.where("kept").select("_id", "_h").distinct(), ["_id", "_h"], "left_semi").select("_row.*")


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base and that the weighed votes call good."""
    rows = packed(docs).select("_row", F.col("_row.text").alias("text"))
    return rules.quality_rules(rows, with_rows=True).where("kept").select("_row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, then hash of the text. Of repeated rows one stays.

    Rows without words are linked with nothing, and all of them stay.
    """
    rows = packed(docs).withColumn("_words", F.coalesce(F.col("_row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    found = near_dedup.near_duplicates(units(docs), near_dedup.Near(shingle=5))
    found = found.where("n_shingles > 0 and _id = component and _h = component_h").select("_id", "_h").distinct()
    one = rows.where("_words").dropDuplicates(["_id", "_h"]).join(found, ["_id", "_h"], "left_semi")
    return one.select("_row.*").unionByName(rows.where("not _words").select("_row.*"))


@stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the texts without the long strings and passages that occur again; n_chars follows the text.

    Strings have 400 bytes and passages 50 words at least. A character goes only as a whole.
    A text may end up empty; a null text becomes empty.
    """
    left = exact_spans.stripped(units(docs), whole_characters=True, passages=True)
    left = left.groupBy("_id", "_h").agg(F.first("kept").cast("string").alias("_kept"))
    rows = packed(docs).withColumn("_row", F.col("_row").dropFields("text"))
    joined = rows.join(left, ["_id", "_h"])
    made = {"text": F.col("_kept")} | ({"n_chars": F.length("_kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[(made[c] if c in made else F.col("_row")[c]).alias(c) for c in docs.columns])


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' token pieces and their places in sequences of at most 4,096 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, spark, "documents")
    for name, made in STAGES[:-1]:
        docs = saved(made(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

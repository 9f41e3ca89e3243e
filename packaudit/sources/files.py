"""Reading and writing of files, records and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "id string, category string, title string, status string, details string, evidence string, related_id string, application_id string, created_at timestamp"
MANIFEST = "package_id string, company_name string, account_ids array<string>, financial_years array<int>, expected_findings array<string>"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, base_id, sha256, size) of the files below a folder; the base id is the parent folder and the stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.regexp_extract("path", r"([^/]+/[^/]+?)(\.[^./]*)?$", 1)
    return files.select("path", base.alias("base_id"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def spans(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed spans with their text trimmed; empty ones are left out."""
    return spark.read.schema(schema).parquet(path).withColumn("text", F.trim("text")).where("text <> ''")


def records(spark: SparkSession, folder: str, schema: str = HISTORY) -> DataFrame:
    """A folder of JSON records, newest first."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).orderBy(F.desc("created_at"), F.desc("id"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def survey(spark: SparkSession, path: str, questions: list[str]) -> DataFrame:
    """(participant_id, answers): the columns with the questions, else the first ten that begin with 'I '; blank lines are skipped."""
    rows = spark.read.option("header", True).csv(path)
    by_name = {" ".join(c.replace("﻿", "").split()).lower(): c for c in rows.columns}
    found = [by_name.get(" ".join(q.split()).lower()) for q in questions]
    if not all(found) or len(found) != 10:
        found = [c for c in rows.columns if c.replace("﻿", "").startswith("I ")][:10]
    answers = F.array(*[F.col(f"`{c}`").try_cast("int") for c in found])
    filled = rows.where(F.coalesce(*[F.col(f"`{c}`") for c in rows.columns]).isNotNull())
    return filled.select(F.concat(F.lit("R"), F.monotonically_increasing_id() + 1).alias("participant_id"), answers.alias("answers"))


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id", space: str | None = None, order: str | None = None) -> DataFrame:
    """old with new's rows in place of those with the same key; of new rows with one key the last by `order` (any, without one) stays.

    With `space`, the new rows are stamped with this embedding_space.
    """
    if space is not None:
        new = new.withColumn("embedding_space", F.lit(space))
    if order is not None:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    new = new.dropDuplicates([key])
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def without_documents(chunks: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """chunks without those of some documents (or, by application_id, applications)."""
    return chunks.join(gone.select(key).distinct(), key, "left_anti").select(chunks.columns)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the partitions of the applications that chunks has."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("application_id").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def archive_entry(index: DataFrame, document_id: str) -> DataFrame:
    """The file of a document, if the stored id agrees with the one that the key was made from."""
    return index.where((F.col("key") == F.sha2(F.lit(document_id), 256)) & (F.col("document_id") == document_id)).select("filename", "sha256")

"""The rules' verdict on texts whose language they don't know, on tables of one class, and on tables that break a rule as a whole."""

import string

import pytest
from pyspark.sql import functions as F

from packaudit.llm import rules

SF = "/root/testdata/sf0.01"
OTHER = "qzxwvkjpybfmghdcrtlsnoueia"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").cache()


def shares(found):
    return {bool(r[0]): (r["kept"], r["n"]) for r in found.groupBy(F.col("doc_id") >= 10**6).agg(F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count("*").alias("n")).collect()}


def other_letters(documents):
    lower = string.ascii_lowercase
    return documents.select((F.col("doc_id") + 10**6).alias("doc_id"), F.translate("text", lower + lower.upper(), OTHER + OTHER.upper()).alias("text"))


def test_other_letters_keep_their_share(documents):
    own, n = shares(rules.quality_rules(documents))[False]
    alone, _ = shares(rules.quality_rules(other_letters(documents)))[True]
    assert 0.8 * n < own < 0.9 * n and alone >= 0.97 * own
    mixed = shares(rules.quality_rules(documents.unionByName(other_letters(documents).where("doc_id % 10 = 3"))))
    assert mixed[False][0] >= 0.97 * own and mixed[True][0] >= 0.8 * mixed[True][1]


def test_labelled_bad_texts_are_rejected(spark, documents):
    found = rules.quality_rules(documents).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed")
    by = {r["quality"]: (r["kept"], r["n"]) for r in found.groupBy("quality").agg(F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count("*").alias("n")).collect()}
    assert by[0][0] <= 0.05 * by[0][1] and by[1][0] >= 0.99 * by[1][1]


@pytest.mark.parametrize("quality", [0, 1])
def test_a_table_of_one_class_keeps_what_passes_the_base(spark, documents, quality):
    own = documents.join(spark.read.parquet(f"{SF}/labels.parquet").where(F.col("quality") == quality), "doc_id", "left_semi")
    found = rules.quality_rules(own).where("not base_failed")
    assert found.where("kept").count() >= 0.97 * found.count() > 0


def test_a_rule_that_all_texts_break_rejects_none(spark):
    rows = [(i, f"title {i} " + " ".join(f"word{(i * 7 + j) % 97} item{j}" for j in range(30))) for i in range(40)]
    found = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("not base_failed").count() == 40 and found.where("kept").count() == 40

"""Chunk texts and faithfulness with known results."""

from datetime import date
from decimal import Decimal as D

from packaudit.operators import chunks


def test_transactions_and_directors(spark):
    rows = spark.createDataFrame([("d", 3, date(2025, 1, 5), "CARD FEE", None, D("2.50"), D("97.50"))], "document_id string, row_index int, txn_date date, description string, credit decimal(18,2), debit decimal(18,2), balance decimal(18,2)")
    assert tuple(chunks.transaction_chunks(rows).first()) == ("d:transaction:3", "d", "transaction", 1, "2025-01-05 | debit | RM 2.50 | balance RM 97.50 | CARD FEE")
    people = spark.createDataFrame([("r", 0, 1, "A B", None, "Chair")], "document_id string, row_index int, number int, name string, nric string, role string")
    from pyspark.sql import functions as F

    assert tuple(chunks.record_chunks(people, "ssm_registration", "director", F.col("row_index")).first()) == ("r:director:0", "r", "director", 1, "Director #1: A B. NRIC/Passport: -. Role: Chair.")


def test_faithfulness_and_coverage(spark):
    bodies = spark.createDataFrame([(1, "One [a:page:1]. Two! Three [b:page:9, a:page:1; CRITICAL]"), (2, "No citation here."), (3, "")], "conv_id int, body string")
    allowed = spark.createDataFrame([("a:page:1",)], "cited string")
    got = {r["conv_id"]: r for r in chunks.faithfulness(bodies, allowed).collect()}
    one = got[1]
    assert (one["citations"], one["valid"], one["invalid"], one["faithfulness"], one["sentences"], one["cited_sentences"], one["sentence_coverage"]) == (3, 2, "b:page:9", 0.666667, 3, 2, 0.666667)
    assert (got[2]["faithfulness"], got[2]["sentence_coverage"], got[3]["faithfulness"], got[3]["sentence_coverage"]) == (1.0, 0.0, 1.0, 1.0)


def test_words_are_grouped_where_their_document_lies(spark):
    """The texts are dealt by document once; the rows of words aren't shuffled again."""
    from packaudit.operators import chunks

    docs = spark.createDataFrame([(f"d{n}", "a b c d e f g h i j") for n in range(9)], "document_id string, text string")
    rows = chunks.row_buckets(chunks.word_spans(docs))
    assert [(r["bucket"], r["spans"], r["text"]) for r in rows.where("document_id = 'd3'").orderBy("bucket").collect()] == [(0, 6, "a b d e g h"), (3, 2, "c f"), (30, 1, "j"), (33, 1, "i")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan

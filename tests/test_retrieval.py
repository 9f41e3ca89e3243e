"""Selection of evidence against a plain loop, guards, status and samples."""

import random

import pytest
from pyspark.sql import functions as F

from packaudit.operators import cashflow, retrieval

HIT = "application_id string, topic_ord int, chunk_id string, document_id string, kind string, score double, text string, accepted boolean"


def plain(topics, per_topic, per_document, chunk_chars, context):
    """One package, one topic after the other; rows are (chunk, document, score, text, accepted)."""
    have, left, kept, states = {}, context, [], {}
    for name in sorted(topics):
        rejected, chosen, docs, seen = 0, [], {}, set()
        if left <= 0:
            states[name] = ("budget_exhausted", 0, [])
            continue
        for chunk, document, _, text, accepted in sorted(topics[name], key=lambda r: (-r[2], r[0])):
            if not accepted:
                rejected += 1
                continue
            key = (document, " ".join(text.lower().split()))
            if key in seen:
                continue
            seen.add(key)
            if docs.get(document, 0) >= per_document:
                continue
            if chunk not in have:
                if left <= 0:
                    break
                have[chunk] = text[: min(chunk_chars, left)]
                left -= len(have[chunk])
            chosen.append(chunk)
            docs[document] = docs.get(document, 0) + 1
            if len(chosen) >= per_topic:
                break
        kept += [(name, n, c) for n, c in enumerate(chosen, 1)]
        states[name] = ("retrieved" if chosen else "no_relevant_evidence", rejected, chosen)
    return kept, have, states


@pytest.mark.parametrize("context", [60, 75, 30, 100_000])
def test_selection_is_that_of_a_plain_loop(spark, context):
    rng = random.Random(context)
    rows, want, states = [], {}, {}
    for app in range(25):
        texts = {f"c{i}": rng.choice(["a b", "A  b", "x" * 15, "y" * 30, "z" * 7 + str(i)]) for i in range(12)}
        topics = {}
        for t in range(5):
            for c in rng.sample(sorted(texts), rng.randrange(9)):
                row = (c, f"d{int(c[1:]) % 3}", rng.choice([0.2, 0.3, 0.5]), texts[c], rng.random() < 0.8)
                topics.setdefault(t, []).append(row)
                rows.append((f"app{app}", t, c, row[1], "tax_return", row[2], row[3], row[4]))
        want[f"app{app}"] = plain({t: topics.get(t, []) for t in range(5)}, 3, 2, 20, context)
    hits = spark.createDataFrame(rows, HIT)
    chosen = retrieval.charged(hits, 3, 2, 20, context).cache()
    got = sorted((r["application_id"], r["topic_ord"], r["topic_place"], r["chunk_id"]) for r in chosen.where("kept").collect())
    assert got == sorted((a, *k) for a, w in want.items() for k in w[0])
    texts = {(r["application_id"], r["chunk_id"]): r["text"] for r in retrieval.evidence(chosen).collect()}
    assert texts == {(a, c): t for a, w in want.items() for c, t in w[1].items()}
    packages = spark.createDataFrame([(a, ["tax_return"]) for a in want], "application_id string, kinds array<string>")
    asked = packages.select("application_id", F.explode(F.array(*[F.lit(t) for t in range(5)])).alias("topic_ord"), F.lit("topic").alias("topic"), "kinds")
    none = spark.createDataFrame([], "application_id string, ord int, chunk_id string")
    found = {(r["application_id"], r["topic_ord"]): (r["status"], r["rejected_hits"], r["chunk_ids"]) for r in retrieval.topic_status(asked, packages, hits, chosen, none, 3, context).collect()}
    assert found == {(a, t): s for a, w in want.items() for t, s in w[2].items()}


def vectors(spark, rows, extra):
    return spark.createDataFrame(rows, extra + ", idx int, weight long")


def test_search_stays_inside_its_filter(spark):
    chunks = vectors(spark, [("c1", "a", "k", 1, 2), ("c2", "a", "other", 1, 2), ("c3", "b", "k", 1, 2), ("c4", "a", "k", 1, 2), ("c4", "a", "k", 2, 2)], "chunk_id string, application_id string, kind string")
    ask = lambda app, kinds: vectors(spark, [("q", app, kinds, 1, 1)], "query_id string, application_id string, kinds array<string>")
    found = lambda q, k=5: [(r["chunk_id"], r["score"]) for r in retrieval.filtered_top(q, chunks, k).orderBy("rank").collect()]
    assert found(ask("a", ["k"])) == [("c1", 1.0), ("c4", 0.707107)]
    assert found(ask("a", ["k", "other"]), 2) == [("c1", 1.0), ("c2", 1.0)]
    assert found(ask("a", [])) == []
    with pytest.raises(ValueError):
        retrieval.filtered_top(ask(" ", ["k"]), chunks, 5)


def test_topics_and_findings(spark):
    packages = spark.createDataFrame([("a", ["bank_statement", "tax_return"])], "application_id string, kinds array<string>")
    findings = spark.createDataFrame([("a", 1, "X", "first", True), ("a", 2, "Y", "second", False), ("a", 3, "Z", "third", True)], "application_id string, finding_ord int, code string, message string, cited boolean")
    found = retrieval.specifications(spark, packages, findings).orderBy("topic_ord").collect()
    assert [r["topic"] for r in found] == ["tax", "character", "capacity", "capital", "collateral", "conditions", "forecast", "validation:X"]


def test_metrics_give_the_capacity_topic_chunks(spark):
    packages = spark.createDataFrame([("a", ["bank_statement"])], "application_id string, kinds array<string>")
    asked = spark.createDataFrame([("a", 2, "capacity", ["bank_statement"]), ("a", 3, "capital", ["audited_financials"])], "application_id string, topic_ord int, topic string, kinds array<string>")
    hits = spark.createDataFrame([], HIT)
    metrics = spark.createDataFrame([("a", 1, "m1"), ("a", 2, "m2"), ("a", 2, "m1")], "application_id string, ord int, chunk_id string")
    topics = retrieval.topic_status(asked, packages, hits, retrieval.charged(hits), metrics)
    assert [(r["status"], r["chunk_ids"]) for r in topics.orderBy("topic_ord").collect()] == [("structured_metrics_available", ["m1", "m2"]), ("not_available", [])]
    assert retrieval.bundle_status(topics, hits).first()["status"] == "no_evidence"


def test_even_samples(spark):
    rows = spark.createDataFrame([("a", i) for i in range(18)] + [("b", i) for i in range(4)], "application_id string, ord int")
    found = cashflow.even_sample(rows, ["application_id"], ["ord"], 5).orderBy("application_id", "ord").collect()
    assert [r["ord"] for r in found if r["application_id"] == "a"] == sorted({round(p * 17 / 4) for p in range(5)})
    assert len([r for r in found if r["application_id"] == "b"]) == 4

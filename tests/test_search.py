"""Searches by hashed vectors: exact against all pairs, without shuffling pairs."""

import random

from pyspark.sql import functions as F

from packaudit.operators import chunks, records, retrieval


def rows(rng, n, words):
    return [(f"c{i:04d}", " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(n)]


def test_top_is_that_of_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "İ"]
    texts = rows(rng, 2500, words) + [("c0001", "more of one id"), ("c9998", None), ("c9999", "")]
    asked = rows(rng, 7, words)
    frame = lambda x: spark.createDataFrame(x, "id string, text string")
    queries, every = chunks.hashed_vectors(frame(asked)), chunks.hashed(frame(texts))
    found = lambda: sorted(map(tuple, records.sparse_top(queries, every, 3, 0.12).collect()))
    q, c = ({(r["id"], r["idx"]): r["weight"] for r in chunks.hashed_vectors(frame(x)).collect()} for x in (asked, texts))
    norm = lambda v: {i: sum(w * w for (j, _), w in v.items() if j == i) for i in {i for i, _ in v}}
    nq, nc, dots = norm(q), norm(c), {}
    for (a, i), x in q.items():
        for b in nc:
            if (b, i) in c:
                dots[a, b] = dots.get((a, b), 0) + x * c[b, i]
    want = []
    for a in nq:
        best = sorted((-round(d / (nq[a] * nc[b]) ** 0.5, 6), b) for (x, b), d in dots.items() if x == a and d > 0)
        want += [(a, b, -s, n) for n, (s, b) in enumerate([x for x in best if -x[0] >= 0.12][:3], 1)]
    assert found() == sorted(want)
    monkeypatch.setattr(chunks, "SENT", 0)
    assert found() == sorted(want)


def test_pairs_are_not_shuffled(spark):
    """Before, each common place of a query and a chunk was a row of a shuffle."""
    texts = spark.createDataFrame([(f"c{i}", "a b c") for i in range(50)], "id string, text string")
    top = records.sparse_top(chunks.hashed_vectors(texts.where("id < 'c2'")), chunks.hashed(texts), 3, 0.12)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2  # the texts by id, the best by query


def test_filtered_top_takes_vectors_of_a_row_each(spark):
    texts = spark.createDataFrame([("a|k", "x y"), ("b|k", "x y"), ("a|l", "x y")], "id string, text string")
    c = chunks.hashed(texts).select(F.col("id").alias("chunk_id"), F.split("id", r"\|")[0].alias("application_id"), F.split("id", r"\|")[1].alias("kind"), "places")
    q = chunks.hashed_vectors(texts.limit(1)).select(F.lit("q").alias("query_id"), F.lit("a").alias("application_id"), F.array(F.lit("k")).alias("kinds"), "idx", "weight")
    assert [(r["chunk_id"], r["score"]) for r in retrieval.filtered_top(q, c, 5).collect()] == [("a|k", 1.0)]

"""Hard negatives and exact top-k against brute force, and their SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from packaudit.llm import gnat, maxscore, queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec int, terms string"


def made(n, seed=1, width=12, grain=8.0):
    """Rows with ties, copies, nulls, odd components and columns whose names clash."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [round(rng.gauss(0, 0.3) * grain) / grain for _ in range(width)]
        out.append((i, v, rng.randrange(4), "x", 1, "y"))
    for i in range(0, n, 9):  # one vector many times
        out[i] = (i, out[0][1], out[i][2], "x", 1, "y")
    out += [(None, out[1][1], 1, "", 0, ""), (n, None, 2, "", 0, ""), (n + 1, [None] + out[2][1][1:], 2, "", 0, ""), (n + 2, [math.nan] * width, 2, "", 0, "")]
    out += [(n + 3, [math.inf] * width, 2, "", 0, ""), (n + 4, out[3][1], None, "", 0, ""), (n + 5, [0.0] * width, 3, "", 0, ""), out[5], out[5]]
    return out


def whole(rows, label):
    """The contract's integer vectors by id."""
    out = {}
    for i, v, x, *_ in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c) for c in v) or (label and x is None):
            continue
        out[i] = (np.array([math.floor(256 * float(np.float32(c))) for c in v]), None if x is None else (x + 1) % 10 if i % 7 == 0 else x)
    return out


def ranked(query, items):
    return sorted(((-int(query @ v), i) for i, v in items))


def top(rows, k=5, every=50):
    items = whole(rows, False)
    out = []
    for q in items:
        if q % every == 0:
            best = ranked(items[q][0], [(i, v) for i, (v, _) in items.items() if i != q])[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def negatives(rows, every=100):
    items, out = whole(rows, True), []
    for a in items:
        if a % every:
            continue
        v, label = items[a]
        for s, p in ranked(v, [(i, x) for i, (x, y) in items.items() if i != a and y == label])[:5]:
            fits = [(t, i) for t, i in ranked(v, [(i, x) for i, (x, y) in items.items() if y != label]) if -30 * s <= -100 * t <= -90 * s]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fits[:10], 1)]
    return sorted(out)


def stored(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(params=[(700, 1), (260, 2), (3, 3), (0, 4)])
def table(request, spark, tmp_path):
    n, seed = request.param
    rows = made(n, seed) if n > 9 else made(20, seed)[:n]
    return rows, stored(spark, rows, tmp_path)


def test_top_k_query(spark, table):
    rows, path = table
    got = queries.op13_maxscore(spark, path).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == top(rows)


def test_hard_negatives_query(spark, table):
    rows, path = table
    got = queries.op11_gnat(spark, path).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == negatives(rows)


def test_small_shards_and_blocks(spark, tmp_path, monkeypatch):
    """Several shards, blocks and levels of trees give what one gives."""
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(gnat, "BLOCK_QUERIES", 3)
    rows = made(1500, 5, width=6, grain=64.0)
    path = stored(spark, rows, tmp_path)
    items = vectors.integer_vectors(spark.read.parquet(f"{path}/embeddings.parquet"), label=F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")))
    monkeypatch.setattr(gnat.index, "__defaults__", (150,))
    got = gnat.hard_negatives(items, items.where("id % 100 = 0"), 5, 10, 30, 90)
    assert sorted(map(tuple, got.collect())) == negatives(rows)
    monkeypatch.setattr(maxscore.index, "__defaults__", (100,))
    every = vectors.integer_vectors(spark.read.parquet(f"{path}/embeddings.parquet"))
    got = maxscore.top_k(every.select("id", maxscore.dense_terms(F.col("vec")).alias("terms")), every.where("id % 50 = 0").select("id", maxscore.dense_query(F.col("vec")).alias("terms")), 5)
    assert sorted(map(tuple, got.collect())) == top(rows)


def test_sparse_terms(spark):
    """Text-like postings: few terms a document, queries with weights of both signs, more wanted than score above 0."""
    rng = random.Random(11)
    items = [(i, {rng.randrange(60): rng.randrange(1, 9) for _ in range(rng.randrange(6))}) for i in range(400)]
    asked = [(10_000 + i, {rng.randrange(70): rng.choice([-3, -1, 1, 2, 5]) for _ in range(4)}) for i in range(30)]
    schema = "id long, terms array<struct<term: int, weight: long>>"
    frames = [spark.createDataFrame([(i, list(t.items())) for i, t in x], schema) for x in (items, asked)]
    got = sorted(map(tuple, maxscore.top_k(*frames, 300).collect()))
    want = []
    for q, t in asked:
        scores = sorted((-sum(w * x.get(c, 0) for c, w in t.items()), i) for i, x in items)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:300], 1)]
    assert got == sorted(want)


def test_non_essential_terms_are_skipped():
    """A document that has only terms under the threshold is never scored."""
    n = 3000
    rows = {"shard": [0] * 4, "term": [-1, 0, 1, 2], "docs": [np.arange(n, dtype=np.int64).tobytes(), np.arange(40, dtype=np.int32).tobytes(), np.arange(100, n, dtype=np.int32).tobytes(), np.arange(n, dtype=np.int32).tobytes()]}
    rows["weights"] = [b"", np.full(40, 100).tobytes(), np.ones(n - 100, np.int64).tobytes(), np.ones(n, np.int64).tobytes()]
    import pyarrow as pa

    shard = maxscore.Shard(pa.table(rows))
    docs, scores = shard.top(-1, np.array([0, 1, 2]), np.array([5, 1, 1]), 3)
    assert docs.tolist() == [0, 1, 2] and scores.tolist() == [501, 501, 501]


def test_ranges_eliminate_subtrees():
    """On clustered rows most leaves are never scored, and the result is exact."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (40, 8))
    rows = np.concatenate([c + rng.integers(-20, 20, (60, 8)) for c in centres])
    import pyarrow as pa

    table = pa.table({"id": pa.array(range(len(rows))), "label": pa.array([0] * len(rows)), "vec": pa.array(rows.tolist(), pa.list_(pa.int64()))})
    squares = float((rows.astype(float) ** 2).sum(1).max())
    splits = gnat.chosen(squares, rows, gnat.SPLITS)
    d = gnat._distances(squares, rows, splits)
    tree = gnat.Tree(gnat._tree(0, squares, splits, d.min(0), d.max(0), table))
    search = gnat.Search(rows[:5], np.arange(5), np.zeros(5, np.int64), np.arange(5), np.full(5, gnat.LEAST), np.full(5, gnat.MOST), 3, True)
    seen = []
    take = search.take
    search.take = lambda windows, ids, labels, own: (seen.append(len(windows) * len(ids)), take(windows, ids, labels, own))
    search.visit(tree)
    scores = rows[:5] @ rows.T
    for q in range(5):
        want = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:3]
        assert list(zip((-search.scores[q]).tolist(), search.ids[q].tolist(), strict=True)) == want
    assert sum(seen) < 0.5 * 5 * len(rows)


def test_large_components_stay_exact():
    a = np.array([[2**30, -(2**30) + 1], [3, 4]])
    assert vectors.products(a, a).tolist() == [[int(x @ y) for y in a.astype(object)] for x in a.astype(object)]


@pytest.mark.parametrize("name", ["op11_gnat", "op13_maxscore"])
def test_same_as_sql(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = queries.queries()[name](spark, sf).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())

"""Near duplicates against all pairs of shingle sets."""

from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packaudit.llm import near_dedup
from packaudit.llm.common import units
from packaudit.llm.near_dedup import Near
from tests.llm.cases import frame, words, words_of

LAST = (1 << 63) - 1


def brute(docs, near):
    sets = []
    for _, text in docs:
        w = words_of("".join(c.lower() if c.isascii() else c for c in text or ""))
        k = near.shingle
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= near.percent * (len(sets[i]) + len(sets[j]) - common):
            root[find(i)] = find(j)
    ids = [LAST if d is None else d for d, _ in docs]
    least = {}
    for i in range(len(docs)):
        least[find(i)] = min(least.get(find(i), LAST), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)]) for i in range(len(docs)))


def check(spark, table, near=Near()):
    got = near_dedup.near_duplicates(units(table), near).collect()
    assert sorted((r["_id"], r["n_shingles"], r["component"]) for r in got) == brute([(r["doc_id"], r["text"]) for r in table.collect()], near)


def test_cases(spark):
    check(spark, frame(spark))


def test_families(spark):
    """Chains of edits: neighbours are similar, ends are not."""
    rng, texts = np.random.default_rng(1), []
    for family in range(6):
        w = words(120, 100 + family)
        for step in range(25):
            if step % 3 == 0:
                w = list(w)
                w[int(rng.integers(len(w)))] = f"e{family}_{step}"
            v = list(w)
            for _ in range(int(rng.integers(0, 4))):
                v[int(rng.integers(len(v)))] = f"x{rng.integers(1000)}"
            texts.append((int(rng.integers(1 << 40)), " ".join(v)))
    check(spark, spark.createDataFrame(texts, "doc_id long, text string"))


def test_nothing(spark):
    assert near_dedup.near_duplicates(units(frame(spark, []))).count() == 0


def test_rare_pairs_leave_out_no_link(spark):
    """Of nodes that are components of their own: all pairs that are links, and few others."""
    near, rng, texts = Near(shingle=3), np.random.default_rng(5), []
    for family in range(4):
        base = words(100 + 30 * family, 300 + family)
        for step in range(30):
            w = list(base)
            for _ in range(int(rng.integers(0, 9))):
                w[int(rng.integers(len(w)))] = f"x{rng.integers(10_000)}"
            del w[: int(rng.integers(0, 6))]
            texts.append((len(texts), " ".join(w)))
    rows = units(spark.createDataFrame(texts, "doc_id long, text string"))
    nodes = near_dedup.signed(rows, near).select(F.col("_id").alias("node"), F.col("_id").alias("root"), "_id", "_h", "odd")
    got = {(min(p), max(p)) for p in near_dedup.rare_pairs(nodes, rows, near).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in texts)]
    links = {(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links <= got and 20 < len(links) and len(got) < 1.6 * len(links)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 63) - 1), max_size=60), st.sets(st.integers(0, (1 << 63) - 1), max_size=60))
def test_parity_sketch_bounds_the_difference(a, b):
    x, y = (near_dedup.parity_sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True)) <= len(a ^ b)


def test_keys_reach_every_pair_within_the_distance():
    near, rng = Near(), np.random.default_rng(2)
    ways = near.left_out()
    for _ in range(300):
        a = rng.integers(0, 4096, near.symbols)
        b = a.copy()
        for i in rng.choice(near.symbols, near.distance, replace=False):
            b[i] ^= 1
        x, y = a.reshape(-1, near.chunk), b.reshape(-1, near.chunk)
        assert any((x[c, list(k)] == y[c, list(k)]).all() for c in range(len(x)) for k in ways)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (200, 201), (202, 201)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90, 201: 200, 202: 200}

"""Periodic runs against a plain search, and op12_periodic whole against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packaudit.llm import periodic, queries
from tests.llm.cases import SCHEMA, frame, rows, words_of


def plain(words):
    """Every run by trying every period: stretches that agree with themselves so many words later."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12 and not any(q % p == 0 and words[i : j + q - p] == words[i + p : j + q] for p in range(1, q)):
                out.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words):
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return [tuple(r) for r in periodic.runs(np.array([names[w] for w in words], np.int64), len(words)).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(0, 60), st.integers(1, 30), st.integers(0, 90))
def test_runs_are_those_of_a_plain_search(words, a, p, length):
    part = (words[a : a + p] or [7]) * 90
    words = words[:a] + part[:length] + words[a:]
    assert found(words) == plain(words)


@pytest.mark.parametrize("period", [1, 2, 3, 5, 6, 7, 14, 15, 30, 31, 62, 63, 64, 126, 127, 128, 254, 255, 600])
def test_every_scale(period):
    rng = random.Random(period)
    part = [rng.randrange(10**6) for _ in range(period)]
    for length in (max(11, 2 * period - 1), max(12, 2 * period), 5 * period + 3):
        words = [-rng.randrange(10**6) - 1 for _ in range(37)] + [part[i % period] for i in range(length)] + [-1]
        assert found(words) == ([(37, 37 + length, period)] if length >= max(12, 2 * period) else [])


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    for b in (2, 4, 8, 16, 32):
        size = 7 if b == 2 else 3 * b - 1
        blocks, windows = rng.integers(0, periodic.PRIME, (20, b)), rng.integers(0, periodic.PRIME, (20, size))
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(blocks[k], windows[k, o : o + b], strict=True)) % periodic.PRIME for o in range(size - b + 1)] for k in range(20)]
        assert periodic.mismatches(blocks, windows).tolist() == want


def test_numbers_that_agree_modulo_the_prime_are_different_words():
    words = np.array([0, periodic.PRIME] * 20, np.int64)
    assert periodic.runs(words, 40).tolist() == [[0, 40, 2]]
    assert not len(periodic.runs(np.arange(40, dtype=np.int64) * periodic.PRIME, 40))


def digests(doc, text):
    """The contract, word for word, for one document."""
    words = words_of(text)
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    spans = [(s, e - s, q) for s, e, q in plain(words)]
    gone = {i for s, m, q in spans for i in range(s + q, s + m)}
    best = min(spans, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in spans)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(spans), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def key(r):
    return [(x is None, x) for x in r]


def test_query_against_brute_force(spark, tmp_path):
    texts = [(d, t if t is None or len(t) < 9000 else t[:9000]) for d, t, *_ in rows()]
    made = [(d, t, "", "", 0, "", "", "") for d, t in texts]
    made += [(5000 + i, f"w{i} " + " ".join(f"a{j % (2 + i % 19)}" for j in range(4 + 3 * i)) + " z", "", "", 0, "", "", "") for i in range(120)]
    spark.createDataFrame(made, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic(spark, str(tmp_path)).select(COLUMNS).collect()
    want = [digests(d, t) for d, t, *_ in made]
    assert any(w[1] for w in want) and any(zlib.crc32(str(w[0]).encode()) % 10 == 0 and w[1] for w in want)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_general_output(spark):
    got = periodic.periodic_runs(frame(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r["collapsed"] is not None and r["n_words"] >= len(r["collapsed"].split(" ")) - 1
    assert periodic.periodic_runs(frame(spark, [])).collect() == []


def test_a_long_text(spark):
    text = " ".join(f"v{i % 30_011}" for i in range(70_000))
    (r,) = periodic.periodic_runs(frame(spark, [(1, text, "", "", 0, "", "", "")])).collect()
    assert [tuple(x) for x in r["runs"]] == [(0, 70_000, 30_011)] and len(r["collapsed"].split()) == 30_011

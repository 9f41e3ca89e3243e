"""The model against one in plain Python, and held-out texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from packaudit.llm import kneser_ney
from packaudit.llm.common import units
from tests.llm.cases import frame


def reference(train):
    """log2-free interpolated modified Kneser-Ney with dictionaries, as a function of (three bytes, byte)."""
    counts = {4: Counter()}
    for t in train:
        t = b"\n\n\n" + t
        counts[4].update(t[i - 3 : i + 1] for i in range(3, len(t)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    total = sum(counts[1].values())
    weights, discounts = {}, {}
    for n in (2, 3, 4):
        c = Counter(counts[n].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        d = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a and b else 0.5 for k, a, b in ((1, c[1], c[2]), (2, c[2], c[3]), (3, c[3], c[4]))]
        sums, off = Counter(), defaultdict(float)
        for g, k in counts[n].items():
            sums[g[:-1]] += k
            off[g[:-1]] += d[min(k, 3) - 1]
        weights[n] = {g: (sums[g], off[g] / sums[g]) for g in sums}
        discounts[n] = d

    def p(gram):
        n = len(gram)
        if n == 1:
            return (counts[1][gram] + 0.5) / (total + 128)
        below = p(gram[1:])
        if gram[:-1] not in weights[n]:
            return below
        sums, gamma = weights[n][gram[:-1]]
        k = counts[n][gram]
        return (k - discounts[n][min(k, 3) - 1] if k else 0) / sums + gamma * below

    return lambda t: sum(math.log(p((b"\n\n\n" + t)[i : i + 4])) for i in range(len(t)))


def test_likelihoods(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcé \n"), rng.integers(1, 300))) for _ in range(60)] + ["zzz", "a" * 70000]
    docs = units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    entries, two = kneser_ney.model(kneser_ney.gram_counts(docs.where("_id < 40")))
    got = {r["_id"]: (r["n_bytes"], r["log_p"]) for r in kneser_ney.log_likelihoods(docs, entries, two).collect()}
    score = reference([t.encode() for t in texts[:40]])
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i][0] == len(t.encode())
        assert got[i][1] == pytest.approx(score(t.encode()), rel=1e-9)


def test_probabilities_of_a_context_add_up(spark):
    docs = units(spark.createDataFrame([(1, "abab abba baab"), (2, "abc")], "doc_id long, text string"))
    entries, two = kneser_ney.model(kneser_ney.gram_counts(docs))
    rows = entries.toPandas()
    tables = {k: (v.sort_values("gram")["gram"].to_numpy(), v.sort_values("gram")["value"].to_numpy()) for k, v in rows.groupby("kind")}
    for context in (b"aba", b"\n\n\n", b"xyz", b"zab"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert np.exp(kneser_ney.log_probabilities(grams, tables, two)).sum() == pytest.approx(1)


def test_held_out_texts(spark):
    rng = np.random.default_rng(4)
    make = lambda n: " ".join("".join(rng.choice(["ba", "ko", "ti", "ren"], rng.integers(1, 4))) for _ in range(n))
    good = [(i, make(80), "en") for i in range(120)]
    junk = [(200 + i, "".join(rng.choice(list("#$%XYZ|"), 300)), "en") for i in range(20)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200, 0, 0)], "doc_id long, quality int, toxic int")
    kept = {r["_id"] for r in kneser_ney.quality(docs, labels).where("kept").collect()}
    assert kept == set(range(120))


def test_languages_with_few_labels(spark):
    """Clean languages (one null) stay whole with 1, 29 and 30 labels, and one label more hardly moves the limit."""
    rng = np.random.default_rng(5)
    say = lambda n, units, most: " ".join("".join(rng.choice(units, rng.integers(1, most))) for _ in range(n))
    docs = [(i, say(80, ["ba", "ko", "ti", "ren"], 4), "en") for i in range(150)] + [(9000, "Ω" * 50, "zz")]
    few = {1000: ("a1", "αβγδεζηθικλμνξοπ", 1), 2000: ("a29", "абвгдежзиклмнопр", 29), 3000: (None, "աբգդեզէըթժիլխծկհ", 30)}
    labels = [(i, 1, 0) for i in range(150)]
    for first, (lang, letters, n) in few.items():
        docs += [(first + i, say(60, list(letters), 9), lang) for i in range(60)]
        docs += [(first + 100 + i, "".join(rng.choice(list("#$%XYZ|"), 300)), lang) for i in range(5)]
        labels += [(first + i, 1, 0) for i in range(n)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = kneser_ney.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r["_id"] for r in got if not r["kept"]} == {first + 100 + i for first in few for i in range(5)}
    limits = {r["lang"]: r["threshold"] for r in got}
    assert limits["a1"] > limits["a29"] and limits["a29"] == pytest.approx(limits[None], rel=0.1) and limits["zz"] == math.inf


def test_odd_rows(spark):
    labels = spark.createDataFrame([(51, 1, 0), (54, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.quality(frame(spark), labels).collect()
    assert all(r["n_bytes"] > 0 for r in got)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in kneser_ney.quality(frame(spark), nothing).collect())
    assert kneser_ney.quality(frame(spark, []), labels).count() == 0

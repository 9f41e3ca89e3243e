"""Window and byte-string removal against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from packaudit.llm import anchors, exact_spans, window_index
from packaudit.llm.anchors import Shape
from packaudit.llm.common import units
from packaudit.llm.suffix_array import common_prefixes, suffix_array
from tests.llm.cases import frame, rows, words_of

LAST = (1 << 63) - 1


def by_words(docs, width):
    first = {}
    for doc, text in docs:
        w = words_of(text)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, LAST), LAST if doc is None else doc)
    out = Counter()
    for doc, text in docs:
        w = words_of(text)
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < (LAST if doc is None else doc) for j in range(i, i + width)}
        out[doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return out


def by_bytes(docs, width):
    seen = Counter()
    for _, text in docs:
        data = (text or "").encode()
        seen.update(data[i : i + width] for i in range(len(data) - width + 1))
    out = Counter()
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if seen[data[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(data)))
        out[doc, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)] += 1
    return out


def doc_of(i):
    return None if i == LAST else i


def check_words(spark, table, shape, batches):
    got = window_index.without_seen_windows(units(table), shape, batches).collect()
    assert Counter((doc_of(r["_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == by_words([(r["doc_id"], r["text"]) for r in table.collect()], shape.width)


def check_bytes(spark, table, shape):
    got = exact_spans.stripped(units(table), shape).collect()
    want = by_bytes([(r["doc_id"], r["text"]) for r in table.collect()], shape.width)
    assert Counter((doc_of(r["_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


def mutated(spark):
    """Texts cut from few passages, at all places, with changes: many partial matches."""
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 50, 60)) for _ in range(3)]
    texts = []
    for i in range(60):
        t = base[rng.integers(3)]
        a, b = sorted(rng.integers(0, len(t), 2))
        texts.append((i, t[a:b] + " " + base[rng.integers(3)][: rng.integers(0, 150)] + ("é" if i % 3 else "")))
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_words_as_dealt(spark):
    check_words(spark, frame(spark), window_index.WORDS, 2)


def test_words_in_short_windows(spark):
    check_words(spark, mutated(spark), Shape(width=8, reach=5, gram=2), 3)


def test_words_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(window_index, "LARGE", 1)
    check_words(spark, mutated(spark), Shape(width=8, reach=5, gram=2), 1)


def test_bytes_as_dealt(spark):
    check_bytes(spark, frame(spark), exact_spans.BYTES)


def test_bytes_in_short_windows(spark, monkeypatch):
    check_bytes(spark, mutated(spark), Shape(width=24, reach=14, gram=5))


def test_bytes_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_spans, "LARGE", 1)
    monkeypatch.setattr(exact_spans, "BANDS", (6, 2, 1))
    check_bytes(spark, mutated(spark), Shape(width=24, reach=14, gram=5))


def test_bytes_in_groups_divided_by_few(spark, monkeypatch):
    monkeypatch.setattr(exact_spans, "LARGE", 4)
    check_bytes(spark, mutated(spark), Shape(width=24, reach=14, gram=5))


def periodic(spark):
    texts = ["a" * 500, "ab" * 300, "abc" * 90 + "x" + "abc" * 90, "x" * 23, "x" * 24, "abab" * 20 + "ba" * 40, "q w e " * 60, "q w " * 70 + "e q w e " * 30, "z z z z z", None]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[2], texts[6]])], "doc_id long, text string")


def test_periodic_texts(spark):
    check_bytes(spark, periodic(spark), Shape(width=24, reach=14, gram=5))
    check_words(spark, periodic(spark), Shape(width=8, reach=5, gram=2), 2)


def by_bytes_and_passages(docs, width):
    """What is left if each byte of a string and each word of a passage of width / 8 words goes that occurs again."""
    strings, passages, n, out = Counter(), Counter(), width // exact_spans.CODE, Counter()
    for _, text in docs:
        data, w = (text or "").encode(), words_of(text)
        strings.update(data[i : i + width] for i in range(len(data) - width + 1))
        passages.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for doc, text in docs:
        data, w = (text or "").encode(), [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        gone, words = bytearray(len(data)), set()
        for i in range(len(data) - width + 1):
            if strings[data[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        for i in range(len(w) - n + 1):
            if passages[tuple(m.group().decode() for m in w[i : i + n])] > 1:
                words.update(range(i, i + n))
        for i in words:
            lo, hi = w[i].start(), w[i + 1].start() if i + 1 in words else w[i].end()
            gone[lo:hi] = b"\x01" * (hi - lo)
        out[doc, len(data), sum(gone), sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(data))), bytes(b for b, g in zip(data, gone) if not g)] += 1
    return out


def test_passages_in_other_spacing_and_shorter_than_a_string(spark):
    """Against brute force, in texts that repeat at all distances too; few letters, so that passages are shorter than strings."""
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(list("abcdefgh"), 40)) for _ in range(3)]
    spaced = [(100 + i, base[i % 3][a : a + 30].replace(" ", "\n " if i % 2 else " ") + f" é{i}") for i, a in enumerate(rng.integers(0, 40, 30).tolist())]
    for docs in ([*map(tuple, mutated(spark).collect()), *spaced, (None, None), (1, "")], [*map(tuple, periodic(spark).collect())]):
        table = spark.createDataFrame(docs, "doc_id long, text string")
        got = exact_spans.stripped(units(table), Shape(width=24, reach=14, gram=5), passages=True).collect()
        want = by_bytes_and_passages(docs, 24)
        assert Counter((doc_of(r["_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


def test_a_megabyte_of_one_letter(spark):
    """Few rows, whatever the length; all of it goes, and so do words that an earlier text has."""
    table = spark.createDataFrame([(1, "a" * 1_000_000), (2, "b " * 200_000), (3, "b " * 300_000)], "doc_id long, text string")
    assert anchors.anchor_rows(units(table), exact_spans.BYTES, by_words=False).count() < 50
    got = {r["_id"]: r for r in exact_spans.stripped(units(table)).collect()}
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2)] == [(1_000_000, 1_000_000, 1), (400_000, 400_000, 1)]
    words = {r["_id"]: r["n_removed"] for r in window_index.without_seen_windows(units(table)).collect()}
    assert words == {1: 0, 2: 0, 3: 300_000}


def test_index_over_three_sessions(spark, tmp_path):
    """Each session opens what the last one left, adds a batch and compacts; the first runs' tables are gone from the catalog."""
    shape, path = Shape(width=8, reach=5, gram=2), f"file://{tmp_path}/index"
    rows = [(r["doc_id"], r["text"]) for r in mutated(spark).collect()]
    want, got = by_words(rows, shape.width), Counter()
    for at in range(0, 60, 20):
        batch, history = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows[at : at + 20], rows[:at]))
        index = window_index.FingerprintIndex.open(spark, path)
        assert len(index.names) == (at > 0) + (at > 20)
        spans = {}
        for r in index.late(units(batch), units(history), shape).collect():
            spans.setdefault(r["_id"], []).append(r.asDict())
        index.close()
        for doc, text in rows[at : at + 20]:
            w = words_of(text)
            gone = {j for a, b in anchors.covered(spans.get(doc, []), shape.width) for j in range(a, b)}
            got[doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    assert got == want
    assert len(window_index.FingerprintIndex.open(spark, path).names) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints_")]


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(anchors, "SEGMENT", 37)
    got = list(zip(*anchors._pieces(np.array([0, 36, 37, 200]), Shape(24, 14, 5)), strict=True))
    covered = defaultdict(set)
    for text, skip, n in got:
        covered[int(text)] |= set(range(int(skip), int(skip + n) - 23))
    assert covered[3] == set(range(177)) and covered[2] == set(range(14)) and not covered[0]


def test_empty_table(spark):
    assert window_index.without_seen_windows(units(frame(spark, []))).count() == 0
    assert exact_spans.stripped(units(frame(spark, []))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(symbols):
    order = suffix_array(np.array(symbols, np.int64)).tolist()
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    shared = common_prefixes(np.array(symbols, np.int64), np.array(order, np.int64)).tolist()
    for r in range(1, len(order)):
        a, b = symbols[order[r - 1] :], symbols[order[r] :]
        assert shared[r] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

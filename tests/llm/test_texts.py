"""BPE, packing, token counts, media columns and rules against brute force and round trips."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packaudit.llm import bpe, matroska, packing, queries, rules, token_counts
from tests.llm.cases import SCHEMA, frame, rows, words, words_of

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.vocabulary()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode_like_the_library(spark, library):
    got = sorted((r["doc_id"] is None, r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode(frame(spark), PATH).collect())
    want = []
    for doc, text, *_ in rows():
        ids = ids_of(library, text)
        want.append((doc is None, doc, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    encoded = bpe.encode(frame(spark), PATH)
    assert sorted(r["decoded"] for r in bpe.decode(encoded, PATH).collect()) == sorted(w[3] for w in want)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_encodes_like_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    cache = bpe.cache_for(PATH)
    pieces = cache.encoder.pieces(text)
    cache.learn([pieces])
    ids = b"".join(cache.ids[p] for p in pieces)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_whole_vocabulary(library):
    encoder = bpe.cache_for(PATH).encoder
    found = encoder.words({t.removesuffix("</w>") for t in list(library.get_vocab())[::7] if t.isascii() and t.removesuffix("</w>").islower() and t.removesuffix("</w>").isalpha()})
    assert found and all(ids == ids_of(library, w.decode()) for w, ids in found)


def test_cache_keeps_a_bound_of_bytes(monkeypatch, library):
    """Generations roll over, long pieces live for one slice, and ids stay the library's."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 200 * bpe.ENTRY_BYTES)
    cache = bpe.Cache(bpe.cache_for(PATH).encoder)
    for k in range(12):
        texts = [f"word{k} {'long' * 40}{k} again, " + " ".join(f"w{k}x{i}" for i in range(90))] * 2
        cut = [cache.encoder.pieces(t) for t in texts]
        cache.learn(cut)
        ids = b"".join(cache.ids[p] for p in cut[0])
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == ids_of(library, texts[0])
        assert len(cache.ids) + len(cache.old[0]) < 900
        assert sum(len(p) > bpe.LONGEST_KEPT for p in cache.ids) <= 2


def test_words_of_the_older_generation_are_not_encoded_again(monkeypatch, library):
    """Nor do pieces that are a word and a mark take room: the word and the mark are kept."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100 * bpe.ENTRY_BYTES)
    encoder = bpe.cache_for(PATH).encoder
    seen, encode = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda words, into: (seen.append(set(words)), encode(words, into)))
    cache = bpe.Cache(encoder)
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(0, 8000, 40)]
    cache.learn([names])
    marked = [f"{w.title()}," for w in names]
    cache.learn([marked])
    assert seen == [set(names), {","}]
    want = ids_of(library, " ".join(marked))
    assert b"".join(cache.ids[p] for p in marked) == struct.pack(f"<{len(want)}I", *want)
    cache.learn([["other"]])
    assert not cache.ids.keys() & set(marked)


def test_packing_places_every_piece_once(spark, library):
    got = packing.pack(frame(spark), PATH, capacity=64).collect()
    want = Counter()
    for doc, text, *_ in rows():
        ids = [*ids_of(library, text), 1]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[doc, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 1


def test_packing_in_salted_parts(spark, monkeypatch):
    """Parts of a length rank after one another; pieces of the full capacity stand alone."""
    monkeypatch.setattr(packing, "RANKED", 10)
    made = [(i, 0, [5, 7, 9, 10][i % 4]) for i in range(400)]
    got = packing.pack_pieces(spark.createDataFrame(made, "doc_id long, piece int, length long"), 10).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter((d, n) for d, _, n in made)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 10 and sorted(b)[0][0] == 0 for b in bins.values())
    assert len(bins) == 100 + 50 + 100 + 100 and sum(k < 0 for k in bins) == 100


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=12))
def test_plan_uses_all_lengths_and_fills_bins(counts):
    made, used, fill = packing.plan(counts, 50), Counter(), Counter()
    for size, first, end, each, base, offset in made:
        assert used[size] == first
        used[size] = end
        for rank in range(first, end):
            fill[base + (rank - first) // each] += size
    assert used == Counter(counts)
    assert max(fill.values()) <= 50


def test_token_counts(spark, library):
    lengths = [len(ids_of(library, t)) for _, t, *_ in rows()]
    got = {r["context_limit"]: r for r in token_counts.token_counts(frame(spark), PATH).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r["truncated_total"] == sum(min(n, limit) for n in lengths)
        assert (r["tokens_total"], r["n_docs"]) == (sum(lengths), lengths.count(limit))
        assert (r["docs_longer"], r["docs_within"]) == (sum(n > limit for n in lengths), sum(n <= limit for n in lengths))
    assert token_counts.token_counts(frame(spark, []), PATH).count() == 0


def test_media_round_trip(spark):
    got = matroska.media_columns(frame(spark)).collect()
    want = Counter()
    for doc, text, *_ in rows():
        data = (text or "").encode()
        want[doc, len(data), data + bytes(-len(data) % 64 if data else 64)] += 1
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["payload"])) for r in got) == want
    for r in got:
        assert r["media_error"] is None
        assert b"".join(bytes(r["media"])[p["offset"] : p["offset"] + p["size"]] for p in r["packets"]) == bytes(r["payload"])
    table = matroska.packet_table(matroska.media_columns(frame(spark)))
    assert table.count() == sum(len(r["packets"]) for r in got)


def test_media_unknown_sizes_groups_and_faults():
    block = matroska._block([b"abc"], 5, matroska.NO_LACING)[2:]
    group = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, block))
    cluster = matroska._id(matroska.CLUSTER) + b"\xff" + matroska._uint(matroska.TIMESTAMP, 7) + group
    file = matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + matroska._element(0xEC, b"void") + cluster
    found = matroska.parse(file)
    assert [p[1] for p in found["packets"]] == [12, 12] and found["error"] is None and found["clusters"] == 2
    assert matroska.parse(file[:-2])["error"] and len(matroska.parse(file[:-2])["packets"]) == 1
    assert matroska.parse(b"")["packets"] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=700), min_size=1, max_size=9), st.integers(1, 3))
def test_lacing(frames, kind):
    block = matroska._block(frames, 0, kind)
    found = matroska.parse(matroska._element(matroska.SEGMENT, matroska._element(matroska.CLUSTER, block)))
    where = matroska._element(matroska.SEGMENT, matroska._element(matroska.CLUSTER, block))
    assert [where[p[2] : p[2] + p[3]] for p in found["packets"]] == frames


def base_of(text):
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rules_base(spark):
    got = rules.quality_rules(frame(spark)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = Counter((doc, *base_of(text)) for doc, text, *_ in rows())
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["quality_probability"] >= 0.5)
    assert rules.quality_rules(frame(spark, [])).count() == 0


def estimated(votes):
    """(share, rates on good, rates on bad) of lists of votes, one by one in plain Python."""
    n, held = len(votes), rules.PRIOR * len(votes) + 1
    suited = [k for k in range(len(votes[0])) if sum(v[k] < 0 for v in votes) < rules.UNSUITED * n]
    p = [rules.OPPOSED if any(v[k] < 0 for k in suited) else rules.UNOPPOSED for v in votes]
    last, first = None, None
    for _ in range(rules.ROUNDS):
        share, rates = (sum(p) + 1) / (n + 2), ([], [])
        for k in range(len(votes[0])):
            every = [(sum(v[k] == x for v in votes) + 1) / (n + 3) for x in (-1, 0, 1)]
            for out, w in zip(rates, (p, [1 - q for q in p]), strict=True):
                out.append([(sum(q for q, v in zip(w, votes, strict=True) if v[k] == x) + held * e) / (sum(w) + held) for x, e in zip((-1, 0, 1), every, strict=True)])
        first = first or rates
        rates = [[[(x + rules.ANCHOR * f) / (1 + rules.ANCHOR) for x, f in zip(a, b, strict=True)] for a, b in zip(now, then, strict=True)] for now, then in zip(rates, first, strict=True)]
        good, bad = rates
        p = []
        for v in votes:
            odds = math.log(share / (1 - share))
            for k, x in enumerate(v):
                w = math.log(good[k][x + 1] / bad[k][x + 1])
                odds += min(w, 0) if x < 0 else max(w, 0) if x > 0 else max(-rules.ABSTENTION, min(w, rules.ABSTENTION))
            p.append(1 / (1 + math.exp(-odds)))
        now = [share, *(x for side in rates for rule in side for x in rule)]
        if last and max(abs(a - b) for a, b in zip(now, last, strict=True)) < rules.SETTLED:
            break
        last = now
    return share, good, bad, p


def spam_and_prose(spark):
    """Prose, menus and symbol spam, all of which pass the base, and some that fail it."""
    made, filler = [], "the of and to in is that it for was".split()
    for i in range(120):
        w = [x.translate(str.maketrans("0123456789", "klmnopqrst")) for x in words(80 + i % 40, 500 + i)]
        if i % 6 == 0:
            text = " | ".join(w)
        elif i % 6 == 1 and i % 4 == 1:
            text = " ".join(x + "&&&" for x in w)
        else:
            text = "".join(f"{x} {filler[(i + j) % 10]}{'. ' if j % 6 == 5 else ' '}" for j, x in enumerate(w))
        made.append((i, text))
    return spark.createDataFrame([*made, (900, "a b c"), (901, "x y z u v " * 9), (902, None)], "doc_id long, text string")


def test_rules_estimate_like_plain_python(spark):
    names = list(rules.votes())
    for table in (frame(spark).select("doc_id", "text"), spam_and_prose(spark)):
        made = rules.features(table).withColumns({f"_v_{n}": v for n, v in rules.votes().items()}).drop("_f")
        model = rules.fit(made, names)
        share, good, bad, _ = estimated([[r[f"_v_{n}"] for n in names] for r in made.collect()])
        assert model.share == pytest.approx(share)
        for k, n in enumerate(names):
            assert model.good[n] == pytest.approx(good[k]) and model.bad[n] == pytest.approx(bad[k])


def test_rules_verdict_is_more_than_the_base(spark):
    """The whole verdict by hand: votes of texts that pass the base, their posterior, and spam that goes though it passes."""
    table = spam_and_prose(spark)
    got = {r["doc_id"]: r for r in rules.quality_rules(table).collect()}
    made = rules.features(table).withColumns({f"_v_{n}": v for n, v in rules.votes().items()})
    rows = [r for r in made.collect() if not got[r["doc_id"]]["base_failed"]]
    *_, p = estimated([[r[f"_v_{n}"] for n in rules.votes()] for r in rows])
    for r, q in zip(rows, p, strict=True):
        assert got[r["doc_id"]]["quality_probability"] == pytest.approx(q, abs=2e-6)
        assert got[r["doc_id"]]["kept"] == (q >= 0.5)
    spam = {i for i in range(120) if i % 6 == 0 or (i % 6 == 1 and i % 4 == 1)}
    assert {i for i, r in got.items() if not r["kept"]} == spam | {900, 901, 902}
    assert {i for i, r in got.items() if r["base_failed"]} == {900, 901, 902}


def test_clashing_columns_survive_with_rows(spark):
    got = rules.quality_rules(frame(spark), with_rows=True)
    assert {"doc_id", "text", "lang", "source", "n_chars", "length", "_h", "kept"} <= set(got.columns)
    assert got.count() == len(rows())


def test_token_limits_over_many_blocks(spark):
    """Lengths in one block, in several blocks of a group and in several groups; limits between lengths."""
    rows = [(0, 2), (5, 1), (1500, 3), (1023, 1), (1024, 1), (3_000_000, 1), (2_100_000, 2)]
    lengths = [n for n, k in rows for _ in range(k)]
    table = spark.createDataFrame(rows, "n_tokens long, n_docs long")
    for r in token_counts.limits(table).collect():
        limit = r["context_limit"]
        assert (r["docs_longer"], r["truncated_total"]) == (sum(n > limit for n in lengths), sum(min(n, limit) for n in lengths))
        assert r["tokens_total"] == sum(lengths)
    for limit in (1, 1000, 2_500_000, 9_000_000):
        r = token_counts.at_limit(table, limit).first()
        assert (r["docs_longer"], r["truncated_total"]) == (sum(n > limit for n in lengths), sum(min(n, limit) for n in lengths))


def test_media_frame_times_and_cut_files():
    payload = bytes(i % 251 for i in range(512 * 150))
    file = matroska.mux(payload)
    found = matroska.parse(file)
    assert found["error"] is None and [p[1] for p in found["packets"]] == [i * 64 for i in range(150)]
    cut = matroska.parse(file[:-5])
    assert cut["error"] and cut["packets"] == found["packets"]
    half = matroska.parse(file[: len(file) // 2])
    assert half["error"] and 0 < len(half["packets"]) < 150
    assert half["packets"] == found["packets"][: len(half["packets"])]

"""Small documents with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, length string, _h string"


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n)]


def rows():
    passage = " ".join(words(90, 1))
    long_passage = " ".join(words(140, 2))
    texts = [
        None,
        "",
        "   \n\t ",
        "one",
        "One two three",
        "one two THREE",
        " ".join(words(60, 3)) + " " + passage + " " + " ".join(words(40, 4)),
        passage,
        " ".join(words(30, 5)) + "\n" + passage,
        " ".join(words(70, 6) + ["tail"] + long_passage.split()),
        long_passage + " é ç ü " + " ".join(words(55, 7)),
        long_passage + " é ç è " + " ".join(words(55, 7)),
        "le là " + long_passage[3:] + " " + passage[:-5],
        "aaaa" * 400,
        "aaaa" * 401,
        "a b " * 120,
        "x " * 260,
        " ".join(words(300, 8)),
        " ".join(words(299, 8) + ["other"]),
        " ".join(words(300, 8)[10:]),
        " ".join(words(290, 8) + words(10, 9)),
        " ".join(words(5000, 10)) + " " + " ".join(words(300, 8)),
        "line of words here again\n" * 30,
        "UPPER CASE!! SHOUTS!! " * 20,
        "odd\x1cseparators\x85and\xa0others <|endoftext|> 'S don't 1234 ΑΣ",
    ]
    base = [(i * 3, t, "en", f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    copies = [(1000 + i, texts[17], None, None, None, None, None, None) for i in range(7)]
    return [*base, *copies, base[9], base[9], (None, texts[7], None, None, None, None, None, None), (27, "same id, other text", "fr", "s", 1, "", "", "")]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")

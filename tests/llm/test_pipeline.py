"""The pipeline's stages, and pages."""

from collections import Counter

import pytest

import corpus_pipeline
from packaudit.llm import html_extract
from packaudit.llm.common import table, units
from packaudit.llm.near_dedup import Near
from tests.llm.cases import SCHEMA, frame, rows, words
from tests.llm.test_near import brute

LAST = (1 << 63) - 1


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    frame(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(51, 1, 0), (18, 1, 0), (21, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(sf_dir, spark, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_near_stage_leaves_one_of_each_group(spark, sf_dir):
    docs = table(sf_dir, spark, "documents")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    want = {(i, None) for i, n, c in brute([(d, t) for d, t, *_ in rows()], Near()) if i == c}
    assert {(LAST if d is None else d, None) for d, _ in got} == want
    assert len(got) == len(set(got))


def test_near_stage_compares_five_words(spark, sf_dir):
    """Three changed words in 115: linked by sets of four words (100 of 124), not of five (96 of 126)."""
    first = words(115, 40)
    second = [f"new{i}" if i in (20, 50, 80) else w for i, w in enumerate(first)]
    texts = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join([*first[:-1], "end"]))]
    assert [c for *_, c in brute(texts[:2], Near(shingle=4))] == [1, 1]
    docs = spark.createDataFrame([(*t, *[None] * 6) for t in texts], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [1, 2]


def test_near_stage_without_ids(spark, sf_dir):
    """Of near copies one stays, whatever their ids; rows without words stay, alike or not."""
    base = words(200, 41)
    copy = lambda w: " ".join([*base[:-1], w])
    other = " ".join(words(200, 42))
    docs = [(None, copy("p")), (None, copy("q")), (None, copy("q")), (7, other), (7, other + " more"), (None, None), (None, ""), (8, " "), (8, " ")]
    docs = spark.createDataFrame([(*d, f"l{i}", *[None] * 5) for i, d in enumerate(docs)], SCHEMA)
    got = [int(r["lang"][1:]) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(i for i in got if i > 4) == [5, 6, 7, 8]
    assert len([i for i in got if i < 3]) == 1 and len([i for i in got if i in (3, 4)]) == 1 and len(got) == 6


def test_suffix_stage_keeps_rows_and_counts(spark, sf_dir):
    docs = table(sf_dir, spark, "documents")
    got = corpus_pipeline.suffix_array_dedup(spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in rows())
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["doc_id"]: r["text"] for r in got}
    assert by_id[1001] == "" and by_id[12] == "One two three"


def test_suffix_stage_takes_passages_of_fifty_words(spark, sf_dir):
    """52 words of under 400 bytes go from both texts, in other spacing too; 49 words stay."""
    passage, short = words(52, 50), words(49, 51)
    assert len(" ".join(passage).encode()) < 400
    texts = [" ".join([*words(60, 52 + i), *p, *words(60, 60 + i)]) for i, p in enumerate((passage, short, short))] + [" ".join(words(60, 70)) + "\n" + "\n".join(passage)]
    docs = spark.createDataFrame([(i, t, *[None] * 6) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_array_dedup(spark, docs, sf_dir).collect()}
    assert got[0].split() == [*words(60, 52), *words(60, 60)] and got[3].split() == words(60, 70)
    assert got[1] == texts[1] and got[2] == texts[2]


HTML = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a><li><a href="/b">Other</a></ul></nav>
<div class="ad">Buy our wonderful things today, they are cheap and good.</div>
<article><h1>Title &amp; more</h1><p>First  paragraph with some words, and a <a href="/x">link</a> in it,
which goes on for long enough to be read by anyone.<p>Second &eacute;t&eacute; paragraph; it has words, too, and it ends here.<br>After the break.</article>
<footer>&copy; somebody, all rights reserved.</footer><script>var t="</p>";</script></body></html>"""


def pages(spark):
    import re

    more = [(i, f"u{i}", re.sub("Second", f"Number {i} of these", HTML)) for i in range(12)]
    return spark.createDataFrame([*more, (50, None, HTML), (50, None, HTML), (51, "u", None), (None, "u", ""), (52, "u", "<nav><a href=x>only</a></nav>")], "page_id long, url string, html string")


def test_main_text(spark):
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(pages(spark)).collect()]
    text = (
        "Title & more\nFirst paragraph with some words, and a link in it, which goes on for long enough to be read by anyone.\n"
        "Second été paragraph; it has words, too, and it ends here. After the break."
    )
    assert got.count((50, text)) == 2
    assert (51, "") in got and (None, "") in got and len(got) == 17
    assert html_extract.extract(pages(spark).limit(0)).count() == 0


def test_decoding_is_consistent_and_the_best():
    import itertools

    import numpy as np

    page = html_extract.Page("<div><p>a</p><div>b<p>c</p></div></div>")
    rng, n = np.random.default_rng(1), len(page.tag)
    leaves = [i for i in range(n) if page.text[i] is not None]
    for _ in range(50):
        p = rng.random(n)
        best = max(
            (c for c in itertools.product([0, 1], repeat=n) if c[0] and all(c[page.parent[i]] >= c[i] for i in range(1, n))),
            key=lambda c: sum(np.log(p[i] if c[i] else 1 - p[i]) for i in range(1, n)),
        )
        assert page.decoded(p) == "\n".join(page.text[i] for i in leaves if best[i])


def test_many_open_blocks():
    """Every block has its own node and its own end, however many are open."""
    nested = "<div>" * 1000 + "deep" + "</div>" * 1000
    page = html_extract.Page(f'<div class="comments">{nested}<p>still a comment</div><article>text</article>')
    where = {t: page.parent[i] for i, t in enumerate(page.text) if t}
    outer = page.names.index(" comments")
    assert page.tag.count("div") == 1001 and page.parent[where["still a comment"]] == outer
    assert page.tag[where["text"]] == "article" and page.parent[where["text"]] == 0
    page = html_extract.Page("<article>" + "".join(f"<div id=d{i}>item {i}" for i in range(1000)) + "<ul><li>a<li>b</ul><p>last</article><p>after")
    where = {t: page.parent[i] for i, t in enumerate(page.text) if t}
    assert all(page.names[where[f"item {i}"]] == f" d{i}" for i in range(1000))
    assert page.names[page.parent[where["last"]]] == " d999" and page.parent[where["after"]] == 0
    assert page.parent[where["a"]] == page.parent[where["b"]] and page.tag[page.parent[where["a"]]] == "ul"


def test_held_out_pages_of_other_make():
    import numpy as np

    rng = np.random.default_rng(2)
    others = ["some words that are said elsewhere, and more of them", "short text"]
    made = [v for i in range(30) for v in html_extract.variants(HTML.replace("Second", f"{i} second " * (i % 5)), others, rng)]
    fit, held = made[:80], made[80:]
    parsed = [html_extract.Page(h) for h in fit]
    forest = html_extract.Forest.fit(np.concatenate([p.features() for p in parsed]), np.concatenate([p.truth() for p in parsed]).astype(float))
    right = total = 0
    for p in map(html_extract.Page, held):
        found = forest.probability(p.features()) > 0.5
        right, total = right + int((found == p.truth()).sum()), total + len(found)
    assert right / total > 0.97

"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.llm.common import slices

#: The model is fitted on at most this many pages of at most so many characters, the first by a hash of their key.
TRAIN_PAGES, TRAIN_CHARS = 240, 40_000
TREES, DEPTH, BINS, RATE, SMOOTH = 40, 3, 32, 0.3, 1.0

# HTML elements by kind
BLOCKS = frozenset(
    "html head body div article section main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot "
    "tr td th caption form fieldset legend figure figcaption blockquote pre address details summary dialog menu button select option label hr center".split()
)
RAW = frozenset("script style noscript template textarea iframe title svg object canvas".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
CLOSES = {
    "li": ("li", {"ul", "ol", "menu"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "tr": ("tr", {"table"}),
    "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "option": ("option", {"select"}),
}
# Parts of class, id and role names
CONTENT_NAMES = re.compile(r"article|post|entry|content|story|main|body|text|prose|markdown|blog", re.I)
OTHER_NAMES = re.compile(
    r"nav|menu|head|foot|side|\bads?\b|advert|promo|sponsor|banner|cookie|consent|notice|alert|comment|repl(y|ies)|discuss|share|social|"
    r"relat|recommend|form|login|subscri|newsletter|popup|modal|breadcrumb|pag(er|ination)|widget|copyright|meta|tags?\b",
    re.I,
)
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Class, id and role tokens are features by a hash, so many of them.
TOKENS = 32
KINDS = ["", "article main", "section div", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset button select option label legend", "table tbody thead tr td th"]
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}

HEAD = re.compile(r"<(/?)([A-Za-z][^\s/><]*)")
VALUE = re.compile(r"""=\s*(["'])""")
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})\b", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAMES = [
    "kind", "parent_kind", "depth", "content_name", "other_name", "content_above", "other_above", "in_article", "in_other", "text", "words",
    "link_share", "density", "marks", "paragraphs", "fields", "siblings", "place", "page_place", "text_share", "sibling_text", "sibling_links", "leaf",
]


def tokens(html: str) -> Iterator[tuple[int, int, str, str | None, str]]:
    """(start, end, '/' of an end tag, tag or None for a comment or declaration, attributes).

    Each byte is looked at a fixed number of times: a tag ends at the first > outside quoted
    values, a quote that is never closed counts for nothing, a comment that isn't ends at its
    first >, and where no > is left, the rest is text.
    """
    at, missing = 0, set()

    def find(what: str, start: int) -> int:
        found = -1 if what in missing else html.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while (start := find("<", at)) >= 0:
        if m := HEAD.match(html, start):
            i, end = m.end(), find(">", m.end())
            while end >= 0 and (q := VALUE.search(html, i, end)):
                i = find(q[1], q.end()) + 1
                if not i:
                    break
                if i > end:
                    end = find(">", i)
            if end < 0:
                return
            yield start, end + 1, m[1], m[2].lower(), html[m.end() : end]
            at = end + 1
        elif html[start + 1 : start + 2] in ("!", "?", "/"):
            end = find("-->", start + 4) + 2 if html.startswith("<!--", start) else 1
            end = find(">", start) if end < 2 else end
            if end < 0:
                return
            yield start, end + 1, "", None, ""
            at = end + 1
        else:
            at = start + 1


class Page:
    """The block tree of a page. Text between block boundaries is a leaf of the block around it."""

    def __init__(self, html: str):
        self.tag, self.parent, self.names, self.mark = ["html"], [-1], [""], [None]
        self.text: list[str | None] = [None]
        self.links: list[int] = [0]
        self.tags: list[int] = [0]
        open_, parts, link, linked, at, skip = [0], [], 0, 0, 0, -1
        #: where each tag's open blocks are in open_, the innermost last; the root isn't among them
        places: dict[str, list[int]] = {}

        def innermost(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def close_from(place: int) -> None:
            while len(open_) > place:
                places[self.tag[open_.pop()]].pop()

        def flush() -> None:
            nonlocal linked
            text = unescape("".join(parts)).split() if parts else ()
            if text:
                self._add("", open_[-1], "", None, " ".join(text), linked)
            parts.clear()
            linked = 0

        unclosed: set[str] = set()
        for start, end, closing, tag, attributes in tokens(html):
            if start < skip:
                continue
            if start > at:
                parts.append(html[at:start])
                if link:
                    linked += start - at
            at = end
            if tag is None:
                continue
            if closing:
                if tag == "a":
                    link = max(0, link - 1)
                elif tag in BLOCKS:
                    flush()
                    if place := innermost((tag,)):
                        close_from(place)
                    link = 0
                continue
            if tag in RAW and not attributes.endswith("/"):
                close = None if tag in unclosed else RAW_END[tag].search(html, end)
                parts.append(" ")
                if close:
                    at = skip = close.end()
                    continue
                # never closed: code goes as far as the next block, the text behind other elements stays
                unclosed.add(tag)
                if tag in ("script", "style"):
                    block = BLOCK_TAG.search(html, end)
                    at = skip = block.start() if block else len(html)
                continue
            if tag == "a":
                link += 1
            elif tag == "br" or tag == "img":
                parts.append(" ")
            if tag not in BLOCKS:
                self.tags[open_[-1]] += 1
                continue
            flush()
            link = 0
            if self.tag[open_[-1]] == "p" and len(open_) > 1:
                close_from(len(open_) - 1)
            if tag in CLOSES:
                same, within = CLOSES[tag]
                place = innermost(same.split())
                if place > innermost(within):
                    close_from(place)
            names, mark = "", None
            if attributes:
                for name, a, b, c in ATTRIBUTE.findall(attributes):
                    if name.lower() == "data-y":
                        mark = (a or b or c) == "1"
                    else:
                        names += f" {a or b or c}"
            node = self._add(tag, open_[-1], names, mark, None, 0)
            if tag not in VOID:
                places.setdefault(tag, []).append(len(open_))
                open_.append(node)
        if at < len(html):
            parts.append(html[at:])
        flush()

    def _add(self, tag: str, parent: int, names: str, mark: bool | None, text: str | None, links: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.mark.append(mark)
        self.text.append(text)
        self.links.append(links)
        self.tags.append(1)
        return len(self.tag) - 1

    def features(self) -> np.ndarray:
        """One row per node: tag, names, depth, subtree sums and densities, siblings."""
        n, parent = len(self.tag), self.parent
        chars, words, marks = [0] * n, [0] * n, [0] * n
        links, tags = list(self.links), list(self.tags)
        paragraphs, fields, children, before = [0] * n, [0] * n, [0] * n, [0] * n
        depth, seen = [0] * n, 0
        kind = [KIND.get(t, 0) for t in self.tag]
        content = [1 if s and CONTENT_NAMES.search(s) else 0 for s in self.names]
        other = [1 if s and OTHER_NAMES.search(s) else 0 for s in self.names]
        content_up, other_up, in_article, in_other = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            children[p] += 1
            before[i] = children[p]
            content_up[i] = content_up[p] or content[p]
            other_up[i] = other_up[p] or other[p]
            in_article[i] = in_article[p] or kind[p] == 1
            in_other[i] = in_other[p] or 7 <= kind[p] <= 11
        starts = [0] * n
        for i in range(n):
            starts[i] = seen
            t = self.text[i]
            if t is not None:
                chars[i], words[i] = len(t), t.count(" ") + 1
                marks[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
                seen += chars[i]
            elif kind[i] == 3:
                paragraphs[i] = 1
            elif kind[i] == 11:
                fields[i] = 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            words[p] += words[i]
            marks[p] += marks[i]
            links[p] += links[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
            fields[p] += fields[i]
        names = np.zeros((n, TOKENS), np.float32)
        for i, s in enumerate(self.names):
            if s:
                names[i, [_token_place(t) for t in s.lower().split()]] = 1
        c, w, l = (np.array(x, np.float64) for x in (chars, words, links))
        up = np.maximum(np.array(parent), 0)
        count = np.maximum(np.array(children, np.float64)[up], 1)
        total = max(1.0, float(seen))
        return np.column_stack(
            [
                kind, np.array(kind)[up], depth, content, other, content_up, other_up, in_article, in_other, np.log1p(c), np.log1p(w),
                l / np.maximum(c, 1), c / np.maximum(tags, 1), np.array(marks) / np.maximum(w, 1), paragraphs, fields, count, np.array(before) / count,
                np.array(starts) / total, c / total, c[up] / count, l[up] / np.maximum(c[up], 1), [t is not None for t in self.text],
                names, names[up],
            ]
        ).astype(np.float32)

    def truth(self) -> np.ndarray:
        """Whether each node has main text below it, by the data-y marks of training pages."""
        n = len(self.tag)
        marked, good = [False] * n, [False] * n
        for i in range(1, n):
            marked[i] = marked[self.parent[i]] if self.mark[i] is None else self.mark[i]
        for i in range(n - 1, 0, -1):
            good[i] = good[i] or (self.text[i] is not None and marked[i])
            good[self.parent[i]] = good[self.parent[i]] or good[i]
        return np.array(good)

    def decoded(self, p: np.ndarray) -> str:
        """The text under the best consistent choice: below a node that is left out nothing is kept.

        A kept node scores log p and its children's best; a left-out one the log of 1 - p over its whole subtree.
        """
        parent, n = self.parent, len(self.tag)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
        for i in range(n - 1, 0, -1):
            up = parent[i]
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
        kept = [False] * n
        kept[0] = True
        out = []
        for i in range(1, n):
            kept[i] = kept[parent[i]] and keep[i] > drop[i]
            if kept[i] and self.text[i] is not None:
                out.append(self.text[i])
        return "\n".join(out)


@lru_cache(1 << 14)
def _token_place(token: str) -> int:
    """The feature of a class, id or role token; digits in it don't count."""
    return zlib.crc32(re.sub(r"\d+", "", token).encode()) % TOKENS


class Forest:
    """Boosted trees with logistic loss; each tree asks DEPTH questions a row, from a table of features and limits."""

    def __init__(self, bias: float):
        self.bias = bias
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, limit, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        self = cls(math.log(share / (1 - share)))
        if not len(y):
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        margin = np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, limit = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            at = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    here = np.flatnonzero(at == node)
                    if len(here):
                        feature[node], limit[node] = cls._question(binned[here], gradient[here], weight[here], cuts)
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
            leaves = at - (2**DEPTH - 1)
            g, h = np.bincount(leaves, gradient, 2**DEPTH), np.bincount(leaves, weight, 2**DEPTH)
            leaf = RATE * g / (h + SMOOTH)
            self.trees.append((feature, limit, leaf))
            margin += leaf[leaves]
        return self

    @staticmethod
    def _question(binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
        best, found = 1e-9, (0, math.inf)
        g_all, h_all = gradient.sum(), weight.sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            g = np.cumsum(np.bincount(binned[:, f], gradient, len(c) + 1))[:-1]
            h = np.cumsum(np.bincount(binned[:, f], weight, len(c) + 1))[:-1]
            gain = g**2 / (h + SMOOTH) + (g_all - g) ** 2 / (h_all - h + SMOOTH) - g_all**2 / (h_all + SMOOTH)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (f, float(c[k]))
        return found


def variants(html: str, others: list[str], rng: np.random.Generator) -> list[str]:
    """Training pages from one with an article element: as it is, and with other names and more around and inside.

    data-y marks what is main text and what isn't; features don't see it.
    """
    m = re.search(r"<article\b([^>]*)>(.*)</article\s*>", html, re.S | re.I)
    if not m:
        return []
    before, inner, behind = html[: m.start()], m[2], html[m.end() :]
    say = lambda n=1: " ".join(others[int(i)] for i in rng.integers(0, len(others), n)) if others else "more"
    pick = lambda *names: names[int(rng.integers(len(names)))]
    link = lambda: f'<a href="/x">{say()[:20]}</a>'
    extras = [
        lambda: f'<header class="{pick("site-header", "top", "masthead")}"><h2>{say()[:30]}</h2>{link()}{link()}</header>',
        lambda: f'<{(t := pick("aside", "div"))} class="{pick("sidebar", "widget", "side-col")}"><h3>{say()[:20]}</h3><ul><li>{link()}</li><li>{link()}</li></ul><p>{say()}</p></{t}>',
        lambda: f'<div class="{pick("cookie-notice", "consent", "notice", "alert banner")}"><p>{say()}</p><button>OK</button></div>',
        lambda: f'<div class="{pick("ad", "advert", "ads", "sponsored promo")}">{say()}</div>',
        lambda: f'<form class="{pick("search", "newsletter", "login")}"><label>{say()[:20]}</label><input name="q"><button>Go</button></form>',
        lambda: f'<{(t := pick("section", "div"))} {pick("class", "id")}="{pick("comments", "comment-list", "replies", "discussion")}"><h3>{say()[:20]}</h3>'
        + "".join(f'<div class="{pick("comment", "reply")}"><p>{say(2)}</p><p>{say()}</p></div>' for _ in range(int(rng.integers(1, 4))))
        + f"</{t}>",
        lambda: f'<div class="{pick("related", "share-bar", "breadcrumb")}"><ul><li>{link()}</li><li>{link()}</li></ul></div>',
    ]
    some = lambda k: "".join(f'<div data-y="0">{extras[int(i)]()}</div>' if rng.random() < 0.3 else re.sub(r"^<(\w+)", r'<\1 data-y="0"', extras[int(i)]()) for i in rng.integers(0, len(extras), k))
    parts = re.split(r"(?=<p\b)", inner)
    mixed = "".join(p + (re.sub(r"^<(\w+)", r'<\1 data-y="0"', extras[int(rng.integers(1, len(extras)))]()) if i and rng.random() < 0.15 else "") for i, p in enumerate(parts))
    div = lambda tag, body: re.sub(rf"<(/?){tag}\b", r"<\1div", body, flags=re.I)
    plain = div("nav", div("footer", before)) + "{}" + div("nav", div("footer", behind))
    name = pick("post", "entry-content", "story", "article-body", "content", "main-text")
    return [
        f'{before}<article{m[1]} data-y="1">{inner}</article>{behind}',
        f'{before}{some(2)}<article data-y="1">{mixed}</article>{some(2)}{behind}',
        plain.replace("{}", f'{some(2)}<div class="{name}" data-y="1">{inner}</div>{some(3)}'),
        f'{before}<main>{some(1)}<div id="{name}" data-y="1">{mixed}</div>{some(2)}</main>{behind}',
    ]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = TRAIN_PAGES) -> Forest:
    """A forest from at most `limit` pages with an article element; without any, all nodes are as likely as not."""
    able = pages.where(F.col(html_col).rlike(r"(?i)<article\b") & (F.length(html_col) <= TRAIN_CHARS))
    # first the hashes alone, so that tasks don't send pages that aren't taken
    able = able.select(F.col(html_col).alias("h"), F.xxhash64(id_col, html_col).alias("_k"))
    last = able.select("_k").orderBy("_k").limit(limit).agg(F.max("_k")).first()[0]
    texts = [] if last is None else sorted(r["h"] for r in able.where(F.col("_k") <= last).limit(limit).collect())
    rng = np.random.default_rng(11)
    others = [t for h in texts for t in re.findall(r"<p>([^<]{20,240})", h)][:2000]
    x, y = [], []
    for h in texts:
        for v in variants(h, others, rng):
            page = Page(v)
            x.append(page.features())
            y.append(page.truth())
    if not x:
        return Forest(0.1)
    return Forest.fit(np.concatenate(x), np.concatenate(y).astype(np.float64))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", forest: Forest | None = None) -> DataFrame:
    """(page_id, url, text): the main text of each page; blocks joined by a newline.

    A null or empty page, or one without main text, has the text ''. Nulls in other columns and
    repeated rows stay as they are. The forest (some kilobytes, whatever the input) goes to the tasks.
    """
    forest = forest or fit(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_html"):
            made = [Page(t.decode()) for t in texts]
            features = [p.features() for p in made]
            p = forest.probability(np.concatenate(features))
            out, at = [], 0
            for page, rows in zip(made, features, strict=True):
                out.append(page.decoded(p[at : at + len(rows)]))
                at += len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(pages[id_col].cast("long").alias("_id"), pages[url_col].cast("string").alias("_url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("_html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")

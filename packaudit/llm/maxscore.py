"""Exact top-k search by MaxScore over a sharded inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packaudit.llm.common import saved
from packaudit.llm.vectors import BLOCK_QUERIES, SHARD_ROWS, column, lists, parts, tiles

#: Of each term, so many postings with the highest weights give first candidates, from so many terms of a query.
CHAMPIONS, SEED_TERMS = 4, 8
#: Candidates are scored one by one once they are fewer than this share of a shard.
FEW = 16
#: Terms that are probed between two looks at who is still competitive.
STEP = 8

POSTINGS = "shard int, term int, docs binary, weights binary"


def dense_terms(vec: Column) -> Column:
    """An integer vector as terms with weights over 0: place i is term 2i where positive and 2i + 1 where negative."""
    each = F.transform(vec, lambda x, i: F.struct((2 * i + F.when(x < 0, 1).otherwise(0)).alias("term"), F.abs(x).alias("weight")))
    return F.filter(each, lambda t: t["weight"] > 0)


def dense_query(vec: Column) -> Column:
    """The query's side of dense_terms(): like signs add to the score, unlike ones take from it."""
    return F.concat(dense_terms(vec), F.transform(dense_terms(F.transform(vec, lambda x: -x)), lambda t: F.struct(t["term"], (-t["weight"]).alias("weight"))))


def index(items: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(inverted index, number of shards) of items (id, terms array<struct<term, weight>>), weights over 0.

    A row is one term of one shard: its documents by number, ascending as their ids, and their
    weights. Term -1 holds the shard's ids. A shard has about shard_rows documents, dealt by a
    hash of the id, so that a frequent term's postings are spread over all shards.
    """
    items = saved(items.select("id", F.col("terms.term").alias("terms"), F.col("terms.weight").alias("weights")), "items")
    shards = parts(items.count(), shard_rows)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return saved(dealt.groupBy("shard").applyInArrow(_postings, POSTINGS), "postings"), shards


def _postings(key: tuple, rows: pa.Table) -> pa.Table:
    """The postings of one shard."""
    ids = np.asarray(column(rows, "id"))
    terms, sizes = lists(rows, "terms")
    weights, _ = lists(rows, "weights")
    number = np.empty(len(ids), np.int32)
    number[np.argsort(ids)] = np.arange(len(ids), dtype=np.int32)
    docs = np.repeat(number, sizes)
    order = np.lexsort((docs, terms))
    terms, docs, weights = terms[order], docs[order], weights[order]
    cuts = np.flatnonzero(np.diff(terms)) + 1
    found = [(-1, np.sort(ids).tobytes(), b"")]
    for d, w, t in zip(np.split(docs, cuts), np.split(weights, cuts), terms[np.r_[0, cuts]] if len(terms) else (), strict=False):
        found.append((int(t), d.tobytes(), w.astype(np.int64).tobytes()))
    t, d, w = zip(*found, strict=True)
    return pa.table({"shard": pa.array([key[0].as_py()] * len(t), pa.int32()), "term": pa.array(t, pa.int32()), "docs": pa.array(d, pa.binary()), "weights": pa.array(w, pa.binary())})


class Shard:
    """Postings of a shard, and the same by document."""

    def __init__(self, rows: pa.Table):
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ids = np.empty(0, np.int64)
        for t, d, w in zip(rows.column("term").to_pylist(), rows.column("docs").to_pylist(), rows.column("weights").to_pylist(), strict=True):
            if t < 0:
                self.ids = np.frombuffer(d, np.int64)
            else:
                self.lists[t] = np.frombuffer(d, np.int32), np.frombuffer(w, np.int64)
        self.most = {t: int(w.max()) for t, (_, w) in self.lists.items()}
        self.champions = {t: d[np.argpartition(-w, CHAMPIONS)[:CHAMPIONS]] if len(w) > CHAMPIONS else d for t, (d, w) in self.lists.items()}
        every = sorted(self.lists)
        docs = np.concatenate([self.lists[t][0] for t in every] or [np.empty(0, np.int32)])
        order = np.argsort(docs, kind="stable")
        place = np.repeat(np.arange(len(every)), [len(self.lists[t][0]) for t in every])
        self.place = {t: i for i, t in enumerate(every)}
        self.terms = place[order]
        self.weights = np.concatenate([self.lists[t][1] for t in every] or [np.empty(0, np.int64)])[order]
        self.starts = np.zeros(len(self.ids) + 1, np.int64)
        np.cumsum(np.bincount(docs, minlength=len(self.ids)), out=self.starts[1:])

    def scores(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whole scores of these documents; query holds a weight for each place."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        sums = np.r_[0, np.cumsum(query[self.terms[at]] * self.weights[at])]
        return sums[ends] - sums[ends - sizes]

    def top(self, own: int, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best other than the one with the id `own`; ties go to smaller ids.

        The query's terms are ordered by the most that they can add. Those whose bounds together
        stay under the k-th score found so far are non-essential: a document that is in none of
        the essential lists can't be among the best. The essential lists are traversed; the other
        terms, and those that only take from a score, are probed for the documents that are still
        competitive. Where the k-th score isn't above 0, every document stays a candidate.
        """
        query = np.zeros(len(self.place) + 1, np.int64)
        known = [(int(w) * self.most[t], int(w), t) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if w and t in self.lists]
        for _, w, t in known:
            query[self.place[t]] = w
        adding = sorted((x for x in known if x[1] > 0), reverse=True)
        taking = sorted(x for x in known if x[1] < 0)
        rest = np.r_[np.cumsum([x[0] for x in adding][::-1])[::-1], 0].astype(np.int64)
        mine = np.searchsorted(self.ids, own)
        mine = int(mine) if mine < len(self.ids) and self.ids[mine] == own else -1

        threshold = None
        if adding:
            seeds = np.unique(np.concatenate([self.champions[t] for _, _, t in adding[:SEED_TERMS]]))
            seeds = seeds[seeds != mine]
            if len(seeds) >= k:
                threshold = int(np.partition(self.scores(seeds, query), len(seeds) - k)[len(seeds) - k])
        under = np.flatnonzero(rest < threshold) if threshold is not None else ()
        essential = int(under[0]) if len(under) else len(adding)
        acc = np.zeros(len(self.ids), np.int64)
        for _, w, t in adding[:essential]:
            docs, own_weights = self.lists[t]
            acc[docs] += w * own_weights
        if threshold is None or threshold <= 0:
            left = np.arange(len(self.ids))
        else:
            left = np.flatnonzero((acc > 0) & (acc + rest[essential] >= threshold))
        probes, bound = adding[essential:] + taking, rest[essential]
        for i, (most, w, t) in enumerate(probes):
            if len(left) * FEW < len(self.ids):
                break
            docs, own_weights = self.lists[t]
            acc[docs] += w * own_weights
            bound -= max(most, 0)
            if threshold is not None and i % STEP == STEP - 1:
                left = left[acc[left] + bound >= threshold]
        else:
            return self._best(left, acc[left], mine, k)
        return self._best(left, self.scores(left, query), mine, k)

    @staticmethod
    def _best(docs: np.ndarray, scores: np.ndarray, mine: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        docs, scores = docs[docs != mine], scores[docs != mine]
        first = np.argsort(-scores, kind="stable")[:k]
        return docs[first], scores[first]


HITS = "query_id long, id long, score long"


def top_k(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank int, id, score): for each query the k items with the highest scores, ties to smaller ids.

    Both sides are (id, terms array<struct<term int, weight long>>), one row for each id; a score
    is the sum of the products of weights at shared terms. Items have weights over 0, queries any.
    Items without a shared term score 0. An item with the query's own id doesn't count. Fewer
    than k items give fewer rows, empty tables none. Scores are 64-bit sums.
    """
    postings, shards = index(items)
    queries = saved(queries.select("id", F.col("terms.term").alias("terms"), F.col("terms.weight").alias("weights")), "queries")
    left, right = tiles(queries, postings, shards, parts(queries.count(), BLOCK_QUERIES))

    def run(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        shard, out = Shard(rows), ([], [], [])
        if asked.num_rows and rows.num_rows:
            terms, sizes = lists(asked, "terms")
            weights, _ = lists(asked, "weights")
            ends = np.cumsum(sizes)
            for own, a, b in zip(column(asked, "id").to_pylist(), ends - sizes, ends, strict=True):
                docs, scores = shard.top(own, terms[a:b], weights[a:b], k)
                out[0].append(np.full(len(docs), own))
                out[1].append(shard.ids[docs])
                out[2].append(scores)
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(("query_id", "id", "score"), out, strict=True)})

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

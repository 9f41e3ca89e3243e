"""Multiway hyperplane trees with distance ranges between siblings: nearest rows inside score windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packaudit.llm.common import saved
from packaudit.llm.vectors import BLOCK_QUERIES, SHARD_ROWS, column, matrix, parts, products, tiles

#: Split points of a node, rows that they are chosen from, and rows of a leaf at most where rows differ.
SPLITS, SAMPLE, LEAF = 16, 1_024, 96
#: Stands for no bound of a window.
LEAST, MOST = -(1 << 62), 1 << 62

NODES = "shard int, node int, parent int, slot int, squares double, splits binary, lo binary, hi binary, ids binary, labels binary, vectors binary, width int"


def _tails(squares: float, rows: np.ndarray) -> np.ndarray:
    """One more place for each row, so that all rows have the same length: the distance from a
    query with 0 there then falls exactly as the inner product rises."""
    return np.sqrt(np.maximum(0.0, squares - (rows.astype(float) ** 2).sum(1)))


def _distances(squares: float, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances between rows and points, both with their tails."""
    a, b = rows.astype(float), points.astype(float)
    d = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T) + (_tails(squares, rows)[:, None] - _tails(squares, points)) ** 2
    return np.sqrt(np.maximum(0.0, d))


def chosen(squares: float, rows: np.ndarray, m: int) -> np.ndarray:
    """m rows (fewer, if there aren't as many different ones) that lie far apart: each next one is the farthest from those before."""
    at = [0]
    near = _distances(squares, rows, rows[:1])[:, 0]
    while len(at) < m and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, _distances(squares, rows, rows[at[-1:]])[:, 0])
    return rows[at]


def _ranges(distances: np.ndarray, slots: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """lo[i, j] and hi[i, j]: the range of distances from split i to the rows of subtree j."""
    lo, hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    for j in range(m):
        own = distances[slots == j]
        if len(own):
            lo[:, j], hi[:, j] = own.min(0), own.max(0)
    return lo, hi


class Index:
    """nodes: the trees' rows, a tree for each shard; shards, squares: how many, and the greatest squared length."""

    def __init__(self, nodes: DataFrame, shards: int, squares: float):
        self.nodes, self.shards, self.squares = nodes, shards, squares


def index(items: DataFrame, shard_rows: int = SHARD_ROWS) -> Index:
    """An index of all items (id long, vec array<long>, label long).

    The root's split points are chosen from SAMPLE rows (those with the smallest hashes of their
    ids); every row goes to the nearest, and the root's ranges come from all rows. A subtree of
    more than shard_rows rows is dealt by a hash over several shards, each with the subtree's
    own ranges; below, each shard is one tree.
    """
    items = saved(items.select("id", "vec", "label"), "items")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    squares = float(items.agg(F.max(square).alias("m")).first()["m"] or 0.0)
    sample = [r["vec"] for r in items.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(SAMPLE).select("vec").collect()]
    width = max(map(len, sample), default=0)
    points = np.zeros((len(sample), width), np.int64)
    for i, v in enumerate(sample):
        points[i, : len(v)] = v
    splits = chosen(squares, points, SPLITS) if len(sample) else np.zeros((1, 1), np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(pa.Table.from_batches([batch]), width=splits.shape[1])
            wide = np.zeros((len(splits), rows.shape[1]), np.int64)
            wide[:, : splits.shape[1]] = splits
            d = _distances(squares, rows, wide)
            cell = pa.array(d.argmin(1).astype(np.int32) if len(rows) else [], pa.int32())
            spread = pa.array(list(d), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell, spread], names=[*batch.schema.names, "cell", "distances"])

    placed = saved(items.mapInArrow(assign, "id long, vec array<long>, label long, cell int, distances array<double>"), "cells")
    each = [F.col("distances")[i] for i in range(len(splits))]
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.array(*map(F.min, each)).alias("lo"), F.array(*map(F.max, each)).alias("hi")).collect()
    first, salts, ranges = [0] * len(splits), [1] * len(splits), []
    for r in found:
        first[r["cell"]], salts[r["cell"]] = len(ranges), parts(r["n"], shard_rows)
        ranges += [(np.array(r["lo"]), np.array(r["hi"]))] * salts[r["cell"]]
    start, salt = (F.get(F.array(*map(F.lit, x)), F.col("cell")) for x in (first, salts))
    dealt = placed.drop("distances").withColumn("shard", (start + F.pmod(F.xxhash64("id"), salt)).cast("int"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        lo, hi = ranges[shard]
        return _tree(shard, squares, splits, lo, hi, rows)

    return Index(saved(dealt.groupBy("shard").applyInArrow(build, NODES), "nodes"), max(1, len(ranges)), squares)


def _tree(shard: int, squares: float, splits: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: pa.Table) -> pa.Table:
    """The nodes of a shard's tree. Node 0 holds the root's splits, with their ranges to this shard alone."""
    every = matrix(rows, width=splits.shape[1])
    ids, labels = np.asarray(column(rows, "id")), np.asarray(column(rows, "label"))
    order = np.argsort(ids)
    every, ids, labels = every[order], ids[order], labels[order]
    width, out = every.shape[1], []
    wide = np.zeros((len(splits), width), np.int64)
    wide[:, : splits.shape[1]] = splits
    out.append((shard, 0, -1, 0, squares, wide.tobytes(), lo.tobytes(), hi.tobytes(), b"", b"", b"", width))
    todo = [(np.arange(len(ids)), 0, 0)]
    while todo:
        own, parent, slot = todo.pop()
        node, points = len(out), every[own[:0]]
        if len(own) > LEAF:
            step = max(1, len(own) // SAMPLE)
            points = chosen(squares, every[own[::step]], SPLITS)
        if len(points) > 1:
            d = _distances(squares, every[own], points)
            slots = d.argmin(1)
            low, high = _ranges(d, slots, len(points))
            out.append((shard, node, parent, slot, squares, points.tobytes(), low.tobytes(), high.tobytes(), b"", b"", b"", width))
            todo += [(own[slots == j], node, j) for j in range(len(points)) if (slots == j).any()]
        else:
            out.append((shard, node, parent, slot, squares, b"", b"", b"", ids[own].tobytes(), labels[own].astype(np.int64).tobytes(), every[own].tobytes(), width))
    kinds = (*[pa.int32()] * 4, pa.float64(), *[pa.binary()] * 6, pa.int32())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in NODES.split(", ")])


class Tree:
    def __init__(self, rows: pa.Table):
        self.children: dict[int, dict[int, int]] = {}
        self.inner: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for r in rows.to_pylist():
            self.squares, width, node = r["squares"], r["width"], r["node"]
            self.children.setdefault(r["parent"], {})[r["slot"]] = node
            if r["splits"]:
                splits = np.frombuffer(r["splits"], np.int64).reshape(-1, width)
                shape = (len(splits), -1)
                self.inner[node] = splits, np.frombuffer(r["lo"], float).reshape(shape), np.frombuffer(r["hi"], float).reshape(shape)
            else:
                self.leaves[node] = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, width)
            self.width = width


class Search:
    """The windows of a block of queries, and the best rows found for each so far.

    A window is (query, label, floor, cap): rows with floor <= score <= cap, of the query's label
    or of all others, k of them with the highest scores. By score the rows lie in an annulus
    around the query, whose outer radius shrinks once k are found.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, floors: np.ndarray, caps: np.ndarray, k: int, same: bool):
        self.vectors, self.own, self.labels, self.of, self.floors, self.caps, self.k, self.same = vectors, ids, labels, of, floors.copy(), caps, k, same
        self.scores = np.full((len(of), k), LEAST, np.int64)
        self.ids = np.full((len(of), k), MOST, np.int64)
        self.squared = (vectors.astype(float) ** 2).sum(1)

    def radius(self, squares: float, windows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.squared[self.of[windows]] + squares - 2.0 * scores.astype(float)))

    def alive(self, squares: float, windows: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which windows' annuli meet the ranges [near, far] of distances from their queries; a little room for rounding."""
        room = 1e-6 * (1.0 + np.sqrt(squares))
        return (near <= self.radius(squares, windows, self.floors[windows]) + room) & (far >= self.radius(squares, windows, self.caps[windows]) - room)

    def visit(self, tree: Tree) -> None:
        todo = [(0, np.flatnonzero(self.floors <= self.caps), None, None)]
        while todo:
            node, windows, near, far = todo.pop()
            if near is not None:
                keep = self.alive(tree.squares, windows, near, far)
                windows = windows[keep]
            if not len(windows):
                continue
            if node in tree.leaves:
                self.take(windows, *tree.leaves[node])
                continue
            splits, lo, hi = tree.inner[node]
            asked, which = np.unique(self.of[windows], return_inverse=True)
            d = np.sqrt(np.maximum(0.0, self.squared[asked][:, None] + tree.squares - 2.0 * (self.vectors[asked].astype(float) @ splits.astype(float).T)))
            order = []
            for slot, child in tree.children.get(node, {}).items():
                # each split bounds the distance from the query to the subtree's rows from both sides
                near = np.maximum(d - hi[:, slot], lo[:, slot] - d).max(1)
                far = (d + hi[:, slot]).min(1)
                order.append((float(near.mean()), child, near[which], far[which]))
            for _, child, near, far in sorted(order, key=lambda x: -x[0]):  # the nearest is visited first
                todo.append((child, windows, near, far))

    def take(self, windows: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """Scores all rows of a leaf, in ascending order of ids, and keeps each window's best."""
        asked, which = np.unique(self.of[windows], return_inverse=True)
        scores = products(self.vectors[asked], rows)
        fits = (labels == self.labels[asked][:, None]) == self.same
        fits &= ids != self.own[asked][:, None]
        scores, fits = scores[which], fits[which]
        fits &= (scores >= self.floors[windows][:, None]) & (scores <= self.caps[windows][:, None])
        some = fits.any(1)
        if not some.any():
            return
        windows, found = windows[some], np.where(fits[some], scores[some], LEAST)
        first = np.argsort(-found, axis=1, kind="stable")[:, : self.k]
        score = np.concatenate([self.scores[windows], np.take_along_axis(found, first, 1)], axis=1)
        name = np.concatenate([self.ids[windows], np.where(np.take_along_axis(found, first, 1) == LEAST, MOST, ids[first])], axis=1)
        by_id = np.argsort(name, axis=1, kind="stable")
        score, name = np.take_along_axis(score, by_id, 1), np.take_along_axis(name, by_id, 1)
        best = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        self.scores[windows], self.ids[windows] = np.take_along_axis(score, best, 1), np.take_along_axis(name, best, 1)
        self.floors[windows] = np.maximum(self.floors[windows], self.scores[windows][:, -1])


FOUND = "query_id long, tag long, id long, score long"


def nearest(made: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(query_id, tag, rank int, id, score): the k rows with the highest scores of each window, ties to smaller ids.

    queries: (id, vec, label, windows array<struct<tag long, floor long, cap long>>), one row for
    each id. A row fits a window if floor <= score <= cap and its label is the query's (same) or
    isn't. The row with the query's own id doesn't count. All that fit, if fewer than k.
    """
    queries = saved(queries.select("id", "vec", "label", F.col("windows.tag").alias("tags"), F.col("windows.floor").alias("floors"), F.col("windows.cap").alias("caps")), "asked")
    left, right = tiles(queries, made.nodes, made.shards, parts(queries.count(), BLOCK_QUERIES))

    def run(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "tag", "id", "score")})
        tree = Tree(rows)
        ids, labels = np.asarray(column(asked, "id")), np.asarray(column(asked, "label"))
        tags, sizes = (np.asarray(column(asked, "tags").flatten()), np.diff(np.asarray(column(asked, "tags").offsets)))
        floors, caps = np.asarray(column(asked, "floors").flatten()), np.asarray(column(asked, "caps").flatten())
        of = np.repeat(np.arange(len(ids)), sizes)
        vectors = matrix(asked, width=tree.width)
        if vectors.shape[1] > tree.width:  # places that no row here has
            vectors = np.ascontiguousarray(vectors)
            tree = _wider(tree, vectors.shape[1])
        search = Search(vectors, ids, labels, of, floors, caps, k, same)
        search.visit(tree)
        got = search.ids != MOST
        window = np.nonzero(got)[0]
        columns = (ids[of[window]], tags[window], search.ids[got], search.scores[got])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "tag", "id", "score"), columns, strict=True)})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, FOUND)
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "tag", "rank", "id", "score")


def _wider(tree: Tree, width: int) -> Tree:
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    tree.inner = {n: (pad(s), lo, hi) for n, (s, lo, hi) in tree.inner.items()}
    tree.leaves = {n: (i, x, pad(v)) for n, (i, x, v) in tree.leaves.items()}
    return tree


def hard_negatives(items: DataFrame, anchors: DataFrame, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score).

    items: (id, vec, label), one row for each id (see vectors.integer_vectors); anchors: some of
    them. An anchor's positives are the nearest other rows of its label. Its negatives, for each
    positive, are the nearest rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score. A label with one row
    has no positives and gives none; empty tables give none.
    """
    made = index(items)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(LEAST).alias("floor"), F.lit(MOST).alias("cap")))
    anchors = anchors.select("id", "vec", "label")
    near = saved(nearest(made, anchors.withColumn("windows", whole), positives, same=True).select("query_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole numbers: the least with 100 x >= least * score, the greatest with 100 x <= most * score
    floor, cap = F.expr("(_low + pmod(-_low, 100)) div 100"), F.expr("(_high - pmod(_high, 100)) div 100")
    scaled = near.withColumns({"_low": F.col("positive_score") * least, "_high": F.col("positive_score") * most})
    spans = scaled.select("query_id", F.struct(F.col("positive_id").alias("tag"), floor.alias("floor"), cap.alias("cap")).alias("w"))
    spans = spans.groupBy("query_id").agg(F.collect_list("w").alias("windows"))
    asked = anchors.join(spans, anchors["id"] == spans["query_id"]).drop("query_id")
    found = nearest(made, asked, negatives, same=False)
    return found.join(near.withColumnRenamed("positive_id", "tag"), ["query_id", "tag"]).select(
        F.col("query_id").alias("anchor_id"),
        F.col("tag").alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )

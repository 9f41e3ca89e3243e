"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packaudit.llm.anchors import Rolling, joined_words, mixed, word_values
from packaudit.llm.common import dropped, saved, slices, starts_of


@dataclass(frozen=True)
class Near:
    """Sets of `shingle` words; linked if 100 * intersection >= percent * union.

    A signature has `symbols` values of `bits` bits, cut into chunks of `chunk` values. If two
    signatures differ in at most `distance` values, then by the pigeonhole principle some chunk
    has at most distance // (symbols / chunk) errors; with the default, one. All ways to leave out
    that many values of a chunk are keys, so all pairs within the distance share a key. Texts at
    a similarity of 0.8 differ by more than 29 of 60 values with a probability of about 1e-6.
    """

    shingle: int = 5
    percent: int = 80
    symbols: int = 60
    bits: int = 12
    chunk: int = 4
    distance: int = 29

    def left_out(self) -> list[tuple[int, ...]]:
        """The values of a chunk that a key keeps, for each way to allow its errors."""
        from itertools import combinations

        errors = self.distance // (self.symbols // self.chunk)
        return list(combinations(range(self.chunk), self.chunk - errors))


def shingle_sets(texts: list[bytes], near: Near) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has one, of all its words."""
    data, starts, ends, counts = joined_words([t.lower() for t in texts])
    rolling = Rolling(word_values(data, starts, ends))
    first = starts_of(counts)
    grams = rolling.grams(near.shingle)
    out = []
    for i, n in enumerate(counts.tolist()):
        a = int(first[i])
        if n >= near.shingle:
            out.append(np.unique(grams[a : a + n - near.shingle + 1]))
        elif n:
            out.append(rolling.of(np.array([a]), np.array([a + n])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], near: Near) -> np.ndarray:
    """Signatures (texts x symbols) of non-empty sets: the smallest value of each hash function, cut to some bits."""
    rng = np.random.default_rng(20240607)
    odd = rng.integers(1, 1 << 63, near.symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, near.symbols, dtype=np.uint64)
    every = np.concatenate(sets)
    begins = starts_of(np.array([len(s) for s in sets], np.int64))[:-1]
    out = np.empty((len(sets), near.symbols), np.uint16)
    for k in range(near.symbols):
        least = np.minimum.reduceat((every ^ shift[k]) * odd[k], begins)
        out[:, k] = mixed(least) >> np.uint64(64 - near.bits)
    return out


#: Words of 64 bits in a parity sketch.
ODD = 8


def parity_sketch(members: np.ndarray) -> list[int]:
    """Whether an odd number of a set's members falls on each of 64 * ODD places.

    Two sets differ in at least as many members as their sketches do in bits.
    """
    odd = np.bincount((members >> np.uint64(20)).astype(np.int64) % (64 * ODD), minlength=64 * ODD) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def signed(rows: DataFrame, near: Near) -> DataFrame:
    """(_id, _h, n, s1, s2, sig, odd) of units(): size and 128-bit hash of the shingle set, its signature (null if empty) and parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, near)
            full = [s for s in sets if len(s)]
            made = iter(signatures(full, near) if full else [])
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.ascontiguousarray(digests[:, 0])),
                    pa.array(np.ascontiguousarray(digests[:, 1])),
                    pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([parity_sketch(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["_id", "_h", "n", "s1", "s2", "sig", "odd"],
            )

    return rows.select("_id", "_h", "_t").mapInArrow(run, "_id long, _h long, n long, s1 long, s2 long, sig binary, odd array<bigint>")


def chunk_keys(classes: DataFrame, near: Near) -> DataFrame:
    """(key, node): every chunk's keys with the allowed errors left out."""
    keep = near.left_out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1, near.chunk).astype(np.uint64)
            keys = []
            for way, kept in enumerate(keep):
                key = np.zeros(values.shape[:2], np.uint64)
                for v in kept:
                    key = key << np.uint64(near.bits) | values[:, :, v]
                place = np.arange(values.shape[1], dtype=np.uint64) * np.uint64(len(keep)) + np.uint64(way)
                keys.append(mixed(mixed(key) + place))
            found = np.concatenate(keys, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), found.shape[1]))], names=["key", "node"]
            )

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _shingles(nodes: DataFrame, rows: DataFrame, near: Near) -> DataFrame:
    """(s, node, root, n): a row per shingle of the nodes (node, root, _id, _h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, near)
            sizes = np.array([len(x) for x in sets], np.int64)
            of = pa.array(np.repeat(np.arange(len(sets)), sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets).view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(np.repeat(sizes, sizes))], names=["s", "node", "root", "n"]
            )

    texts = nodes.join(rows.select("_id", "_h", "_t"), ["_id", "_h"]).dropDuplicates(["_id", "_h"]).select("node", "root", "_t")
    return texts.mapInArrow(run, "s long, node long, root long, n long")


#: Sizes of sets within this ratio are in one class.
CLASS = 1.1


def rare_pairs(nodes: DataFrame, rows: DataFrame, near: Near) -> DataFrame:
    """(a, b): pairs of nodes of different roots that can be similar enough. No such pair is left out.

    In the order from rare to frequent, two sets that are similar enough share one of the first
    shingles of each: among n - overlap + 1 of them, where overlap is what the sizes of the two
    ask for. A smaller or equal set must hold it still further in front, and the places of the
    first shared one bound the overlap. So sets whose own edits are more than a link allows meet
    nowhere, however many they are. Shingles that only one node has are counted, not moved.
    Where most rows of a shingle belong to one root, these aren't compared with one another.
    Parity sketches bound the difference of two sets from below, before the two are a pair.
    """
    t = near.percent
    every = _shingles(nodes, rows, near)
    frequent = saved(every.groupBy("s").agg(F.count("*").alias("_f")).where("_f > 1"), "shingles")
    shared = every.join(frequent, "s")
    by_node = Window.partitionBy("node")
    rank = F.row_number().over(by_node.orderBy("_f", "s")) - 1
    placed = shared.withColumns({"_r": rank, "_m": F.count("*").over(by_node)}).withColumn("i", F.col("n") - F.col("_m") + F.col("_r"))
    n, i = F.col("n"), F.col("i")
    placed = saved(placed.where(i <= n - F.ceil(n * t / 100)).select("s", "node", "root", "n", "i"), "rare")
    dropped(frequent)

    def size_class(x: F.Column) -> F.Column:
        return F.floor(F.log(x.cast("double")) / float(np.log(CLASS))).cast("int")

    first = placed.where(i <= n - F.ceil(n * 2 * t / (100 + t))).withColumn("c", size_class(n))
    # sizes that a partner, of the same size at most, may have
    most = F.least(n, F.floor((n - i) * (100 + t) / t) - n)
    least = F.ceil(n * t / 100)
    second = placed.where(most >= least).withColumn("c", F.explode(F.sequence(size_class(least), size_class(most))))
    both = first.select("s", "c", "root", F.lit(1).alias("_l")).unionByName(second.select("s", "c", "root", F.lit(0).alias("_l")))
    counts = both.groupBy("s", "c", "root").agg(F.count("*").alias("_k"), F.max("_l").alias("_l"))
    counts = counts.groupBy("s", "c").agg(F.max(F.struct("_k", "root")).alias("_top"), F.count("*").alias("_roots"), F.max("_l").alias("_l"))
    tops = saved(counts.where("_roots > 1 and _l = 1").select("s", "c", F.col("_top.root").alias("_heavy")), "heavy")
    sketch = nodes.select("node", "odd")
    left = first.join(tops, ["s", "c"]).join(sketch, "node").select("odd", "s", "c", F.col("node").alias("a"), F.col("root").alias("_ra"), F.col("n").alias("na"), F.col("i").alias("ia"), (F.col("root") == F.col("_heavy")).alias("_ha"))
    right = second.join(tops, ["s", "c"]).join(sketch, "node").select("odd", "s", "c", F.col("node").alias("b"), F.col("root").alias("_rb"), F.col("n").alias("nb"), F.col("i").alias("ib"), (F.col("root") == F.col("_heavy")).alias("_hb"))
    left, right = saved(left.withColumnRenamed("odd", "_oa"), "left"), saved(right.withColumnRenamed("odd", "_ob"), "right")
    differ = " + ".join(f"bit_count(_oa[{k}] ^ _ob[{k}])" for k in range(ODD))
    can = f"""_ra <> _rb and (na < nb or na = nb and a < b) and 100 * na >= {t} * nb
        and (100 + {t}) * least(na - ia, nb - ib) >= {t} * (na + nb)
        and (100 + {t}) * (na + nb - ({differ})) >= 2 * {t} * (na + nb)"""
    light = left.where("not _ha").join(right, ["s", "c"]).where(can)
    heavy = left.where("_ha").join(right.where("not _hb"), ["s", "c"]).where(can)
    pairs = saved(light.select("a", "b").unionByName(heavy.select("a", "b")).distinct(), "pairs")
    dropped(left, right, tops, placed)
    return pairs


def confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are as similar as asked for.

    The text of b travels to its pair and on to a; each a's text is joined there once.
    """
    texts = rows.select("_id", "_h", "_t")
    at = classes.select("node", "_id", "_h")
    b = pairs.join(at.withColumnRenamed("node", "b"), "b").join(texts, ["_id", "_h"]).select("a", "b", F.col("_t").alias("tb"))
    a = pairs.select(F.col("a").alias("node")).distinct().join(at, "node").join(texts, ["_id", "_h"]).select(F.col("node").alias("a"), F.col("_t").alias("ta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch, others in slices(batches, "tb"):
            sets = shingle_sets(others, near)
            keep = []
            for i, text in enumerate(batch.column("ta")):
                node = batch.column("a")[i].as_py()
                if node != last:
                    last, own = node, shingle_sets([text.as_py().encode()], near)[0]
                common = len(np.intersect1d(own, sets[i], assume_unique=True))
                keep.append(100 * common >= near.percent * (len(own) + len(sets[i]) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return b.join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternates two steps until nothing changes: every node's larger neighbours move to its
    smallest neighbour, then its smaller ones do. Each step is a minimum per node and a join.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(rows: DataFrame, near: Near = Near()) -> DataFrame:
    """(_id, _h, n_shingles, component, component_h) of each row of units(); component is the smallest id that links reach.

    component_h is the hash of the text that has this id, the smallest if there are several: the
    two together name one text of each component, also where ids are shared or null.

    Rows with equal shingle sets are one node. A node's weight is the number of nodes in its
    buckets: the text that a family of copies comes from has the largest. Each node is first
    compared with one node only, the heaviest that leads one of its buckets; what that confirms
    makes the first components. Nodes that then share a bucket with a node of another component
    are open; of their pairs, those that can be links by their sizes and rarest shingles are
    compared, all of them, so no link that joins two components is missed, while neither the
    pairs inside a group of copies nor those of texts that are merely alike are ever listed.
    Texts without words are linked with nothing.
    """
    every = saved(signed(rows, near), "signed")
    full = every.where("n > 0")
    nodes = full.groupBy("s1", "s2").agg(F.min(F.struct("_id", "_h", "sig", "odd")).alias("_r"))
    classes = saved(nodes.select("s1", "s2", "_r.*").withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = chunk_keys(classes, near)
    sizes = keys.groupBy("key").agg(F.count("*").alias("_n"), F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a < _b")
    sizes = saved(sizes.select("key", "_n"), "sizes")
    shared = saved(keys.join(sizes, "key"), "shared")
    heavy = saved(shared.groupBy("node").agg(F.sum("_n").alias("_w")), "weights")
    weighed = saved(shared.select("key", "node").join(heavy, "node"), "weighed")
    leads = saved(weighed.groupBy("key").agg(F.max(F.struct("_w", F.col("node").alias("lead"))).alias("_l")), "leads")
    best = weighed.join(leads, "key").where("struct(_w, node) < _l").groupBy("node").agg(F.max("_l").alias("_l"))
    best = best.select(F.col("_l.lead").alias("a"), F.col("node").alias("b"))
    stars = saved(best, "stars")
    dropped(sizes, heavy, weighed, leads)
    links = saved(confirmed(stars, classes, rows, near), "links")
    first = saved(components(links), "components")

    def rooted(table: DataFrame) -> DataFrame:
        return table.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))

    placed = saved(rooted(shared.select("key", "node")), "placed")
    mixed_keys = placed.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("key")
    mixed_keys = saved(mixed_keys, "mixed")
    open_ = placed.join(mixed_keys, "key").select("node", "root").distinct()
    open_ = saved(open_.join(classes.select("node", "_id", "_h", "odd"), "node"), "open")
    dropped(stars, shared, placed, mixed_keys)
    pairs = rare_pairs(open_, rows, near)
    more = saved(confirmed(pairs, classes, rows, near), "links")
    roots = saved(components(links.unionByName(more)), "components")

    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct("_id", "_h")).alias("_least"))
    least = least.select("root", F.col("_least._id").alias("component"), F.col("_least._h").alias("component_h"))
    of_set = saved(named.join(least, "root").select("s1", "s2", "component", "component_h"), "roots")
    return (
        every.select("_id", "_h", F.col("n").alias("n_shingles"), "s1", "s2")
        .join(of_set, ["s1", "s2"], "left")
        .select("_id", "_h", "n_shingles", F.coalesce("component", "_id").alias("component"), F.coalesce("component_h", "_h").alias("component_h"))
    )

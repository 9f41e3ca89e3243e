"""Perplexity under an interpolated modified Kneser-Ney model of trusted text, by sharded count joins.

The units are bytes and the order is four. Counts are tables keyed by n-gram; discounts, context
weights and interpolated probabilities come from joins of these tables. To score, slices of
documents send their n-grams, with counts, to the shard of the two bytes in the middle: there
the probabilities of all n-grams around these bytes, seen or not, are at hand, and each slice
gets back one sum per document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.llm.common import keyed, saved, slices, starts_of, units

ORDER = 4
SHARDS = 16
#: Bytes of text whose n-grams one shard task takes at most (a slice goes whole).
SALT_BYTES = 256_000_000
#: Trusted ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Distinct n-grams that a task holds before it passes its counts on.
HELD = 2_000_000
#: The limit of a language: this quantile of its trusted texts, and room above it.
QUANTILE, ROOM = 0.99, 1.1
#: Typical bytes that each text gets in addition, and as how many trusted texts uniform bytes count in a language's limit.
PRIOR_BYTES, UNIFORM_TEXTS = 64, 1
START = b"\n\n\n"


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, as a number, and the texts' lengths."""
    data = np.frombuffer(b"".join(START + t for t in texts), np.uint8).astype(np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    grams = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    starts = starts_of(lengths + 3)[:-1]
    at = np.arange(int(lengths.sum())) + np.repeat(starts - starts_of(lengths)[:-1], lengths)
    return grams[at], lengths


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, n): how often each n-gram is in the texts _t; tasks count first, then Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for _, texts in slices(batches):
            new, n = np.unique(codes(texts)[0], return_counts=True)
            every, place = np.unique(np.concatenate([grams, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
            grams = every
            if len(grams) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(counts)], names=["gram", "n"])
                grams, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(counts)], names=["gram", "n"])

    return rows.select("_t").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of n-grams seen once, twice, and more often; never zero, so that what is new has a probability."""
    row = counts.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    return [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def model(counts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(shard, kind, gram, value) and the table of two-byte probabilities (256 x 256).

    Kinds: 4 and 3 are probabilities of seen n-grams of that length, -4 and -3 weights of what
    comes after seen contexts (in place of the last byte there is a 0). The lower orders count
    the different bytes before an n-gram. What the driver gets are the 65,536 two-byte values.
    """
    at = {4: saved(counts, "grams")}
    for order in (3, 2, 1):
        own = F.col("gram").bitwiseAND((1 << (8 * order)) - 1)
        at[order] = saved(at[order + 1].groupBy(own.alias("gram")).agg(F.count("*").alias("n")), "grams")
    ones = {r["gram"]: r["n"] for r in at[1].collect()}
    single = np.array([ones.get(b, 0) for b in range(256)], np.float64)
    single = (single + 0.5) / (single.sum() + 128)

    def weighed(order: int) -> tuple[DataFrame, DataFrame]:
        d1, d2, d3 = _discounts(at[order])
        n = F.col("n")
        discount = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        table = at[order].withColumn("context", F.shiftright("gram", 8)).withColumn("_d", discount)
        contexts = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum("_d").alias("_gamma"))
        contexts = contexts.select("context", "total", (F.col("_gamma") / F.col("total")).alias("gamma"))
        return table.join(contexts, "context").select("gram", "context", ((n - F.col("_d")) / F.col("total")).alias("share"), "gamma"), contexts

    pairs, after = weighed(2)
    two = np.tile(single, (256, 1))
    for r in after.collect():
        two[r["context"]] *= r["gamma"]
    for r in pairs.collect():
        two[r["gram"] >> 8, r["gram"] & 255] += r["share"]
    spark = counts.sparkSession
    flat = spark.createDataFrame(pd.DataFrame({"_low": np.arange(65536), "_p": two.ravel()}))
    triples, after3 = weighed(3)
    triples = triples.withColumn("_low", F.col("gram").bitwiseAND(0xFFFF)).join(flat, "_low").select("gram", (F.col("share") + F.col("gamma") * F.col("_p")).alias("value"))
    triples = saved(triples, "three")
    quads, after4 = weighed(4)
    quads = quads.withColumn("_low", F.col("gram").bitwiseAND(0xFFFFFF)).join(triples.withColumnsRenamed({"gram": "_low", "value": "_p"}), "_low")
    quads = quads.select("gram", (F.col("share") + F.col("gamma") * F.col("_p")).alias("value"))

    def part(kind: int, table: DataFrame, gram, middle, value: str) -> DataFrame:
        return table.select(_shard(middle).alias("shard"), F.lit(kind).alias("kind"), gram.alias("gram"), F.col(value).alias("value"))

    gram = F.col("gram")
    parts = [
        part(4, quads, gram, F.shiftright(gram, 8).bitwiseAND(0xFFFF), "value"),
        part(3, triples, gram, F.shiftright(gram, 8), "value"),
        part(-4, after4, F.shiftleft("context", 8), F.col("context").bitwiseAND(0xFFFF), "gamma"),
        part(-3, after3, F.shiftleft("context", 8), F.col("context"), "gamma"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return saved(out, "model"), two


def _shard(middle):
    """The shard of two middle bytes; spreads neighbours."""
    return F.shiftright((middle * 40503).bitwiseAND(0xFFFF), 12).cast("int")


def _np_shard(grams: np.ndarray) -> np.ndarray:
    return ((grams >> 8 & 0xFFFF) * 40503 & 0xFFFF) >> 12


def gram_lists(rows: DataFrame, salts: int) -> DataFrame:
    """(slice, salt, shard, ids, lengths, grams, sizes, steps, counts): n-grams of a slice's documents by shard.

    grams ascend; sizes says how many documents have each, steps leads from one of these
    documents to the next (255: go on adding), counts how often each has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, partition = 0, TaskContext.get().partitionId()
        for batch, texts in slices(batches):
            for first in range(0, len(texts), 60_000):
                part = texts[first : first + 60_000]
                grams, lengths = codes(part)
                key = grams.astype(np.uint64) << np.uint64(16) | np.repeat(np.arange(len(part), dtype=np.uint64), lengths)
                key.sort()
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
                counts = np.diff(np.append(new, len(key)))
                gram, doc = (key[new] >> np.uint64(16)).astype(np.uint32), (key[new] & np.uint64(0xFFFF)).astype(np.int64)
                shard = _np_shard(gram)
                # the same name whenever the task runs again
                name, number = f"{partition}-{number}", number + 1
                salt = zlib.crc32(name.encode()) % salts
                ids = np.stack([batch.column(c).slice(first, len(part)).to_numpy() for c in (0, 1)]).tobytes()
                out = []
                for s in range(SHARDS):
                    here = np.flatnonzero(shard == s)
                    g, d, c = gram[here], doc[here], counts[here]
                    head = np.append(True, g[1:] != g[:-1]) if len(g) else np.empty(0, bool)
                    begin = np.flatnonzero(head)
                    step = np.where(head, d, np.diff(d, prepend=0))
                    many = step // 255
                    steps = np.full(len(step) + int(many.sum()), 255, np.uint8)
                    steps[np.cumsum(many + 1) - 1] = step % 255
                    sizes = np.diff(np.append(begin, len(g)))
                    out.append((name, salt, s, ids if s == 0 else None, lengths.tobytes() if s == 0 else None, len(part), g[begin].tobytes(), sizes.astype(np.uint16).tobytes(), steps.tobytes(), c.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    return rows.select("_id", "_h", "_t").mapInArrow(
        run, "slice string, salt int, shard int, ids binary, lengths binary, size int, grams binary, sizes binary, steps binary, counts binary"
    )


_NAMES = ["slice", "salt", "shard", "ids", "lengths", "size", "grams", "sizes", "steps", "counts"]
_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def log_probabilities(grams: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]], two: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of n-grams (numbers of 32 bits)."""
    grams = grams.astype(np.int64)

    def found(kind: int, keys: np.ndarray) -> np.ndarray:
        known, values = tables[kind]
        if not len(known):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], np.nan)

    low = two[grams >> 8 & 255, grams & 255]
    gamma = found(-3, grams & 0xFFFF00)
    three = found(3, grams & 0xFFFFFF)
    three = np.where(np.isnan(three), np.where(np.isnan(gamma), low, gamma * low), three)
    gamma = found(-4, grams & 0xFFFFFF00)
    four = found(4, grams)
    return np.log(np.where(np.isnan(four), np.where(np.isnan(gamma), three, gamma * three), four))


def _scored(two: np.ndarray):
    def run(key, lists: pa.Table, entries: pa.Table) -> pa.Table:
        kinds, keys, values = (entries.column(c).to_numpy() for c in ("kind", "gram", "value"))
        tables = {}
        for kind in (4, 3, -4, -3):
            own = kinds == kind
            order = np.argsort(keys[own])
            tables[kind] = keys[own][order], values[own][order]
        names, sums = [], []
        lists = lists.select(["slice", "size", "grams", "sizes", "steps", "counts", "ids", "lengths"])
        for at in range(lists.num_rows):
            row = lists.slice(at, 1).to_pylist()[0]
            grams, sizes = np.frombuffer(row["grams"], np.uint32), np.frombuffer(row["sizes"], np.uint16).astype(np.int64)
            steps = np.frombuffer(row["steps"], np.uint8).astype(np.int64)
            places = np.cumsum(steps)[steps < 255]
            begin = starts_of(sizes)[:-1]
            if len(places):
                # the running sum starts anew with each n-gram
                before = np.append(0, places)[begin]
                places = places - np.repeat(before, sizes)
            counts = np.ascontiguousarray(np.frombuffer(row["counts"], np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.float64)
            logs = np.repeat(log_probabilities(grams, tables, two), sizes)
            names.append(row["slice"])
            sums.append(np.bincount(places, counts * logs, row["size"]).astype(np.float64).tobytes())
        ids = lists.select(["ids", "lengths"])
        return pa.table(
            {"slice": pa.array(names, pa.string()), "ids": ids.column("ids").cast(pa.binary()), "lengths": ids.column("lengths").cast(pa.binary()), "sums": pa.array(sums, pa.binary())}
        )

    return run


def _added(slice_rows: pd.DataFrame) -> pd.DataFrame:
    """One slice's sums of all shards, added, with the ids and lengths of its documents."""
    if len(slice_rows) != SHARDS:
        raise ValueError(f"slice with {len(slice_rows)} of {SHARDS} shards: its rows changed between two runs of a task")
    first = slice_rows[slice_rows["ids"].notnull()].iloc[0]
    ids = np.frombuffer(first["ids"], np.int64).reshape(2, -1)
    ordered = slice_rows.sort_values("shard")["sums"]
    total = np.sum([np.frombuffer(s, np.float64) for s in ordered], axis=0)
    return pd.DataFrame({"_id": ids[0], "_h": ids[1], "n_bytes": np.frombuffer(first["lengths"], np.int64), "log_p": total})


def log_likelihoods(rows: DataFrame, entries: DataFrame, two: np.ndarray) -> DataFrame:
    """(_id, _h, n_bytes, log_p) of each row of units()."""
    total = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    salts = max(1, math.ceil(total / SALT_BYTES))
    lists = gram_lists(rows, salts)
    spread = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = _scored(two)(key, left, right)
        return out.append_column("shard", pa.array([key[0].as_py()] * out.num_rows, pa.int32()))

    sums = lists.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(run, "slice string, ids binary, lengths binary, sums binary, shard int")
    return sums.groupBy("slice").applyInPandas(_added, "_id long, _h long, n_bytes long, log_p double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_id, _h, lang, n_bytes, perplexity, threshold, kept) of each document with text, keys as in units().

    Trusted are the documents that labels call good (quality 1) and not toxic. A document is kept
    if its perplexity (per byte; towards its language's trusted median by PRIOR_BYTES, for short
    texts) is at most its language's limit: the 0.99 quantile of the language's own trusted texts,
    with 10 % room. The fewer these are, the wider the limit: the logarithm of a perplexity of 256
    (uniform bytes) counts in the limit's like UNIFORM_TEXTS texts, the quantile's like all texts.
    A null language is one of its own. A language without trusted texts can't be judged: its limit
    is infinite, and its texts with bytes are kept.
    Empty and null texts have no row, which counts as not kept. Repeated rows have a row each.
    """
    rows = units(docs, id_col, text_col)
    trusted = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    trusted = saved(trusted, "trusted")
    known = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    entries, two = model(gram_counts(rows.join(known, "_id", "left_semi")))
    scored = log_likelihoods(rows, entries, two)
    language = docs.select(id_col, text_col, docs[lang_col].cast("string").alias("_lang"))
    language = keyed(language, id_col, text_col).groupBy("_id", "_h").agg(F.min("_lang").alias("lang"))
    scored = saved(scored.where("n_bytes > 0").join(language, ["_id", "_h"], "left"), "scored")
    good = scored.join(known, "_id", "left_semi")
    own = -F.col("log_p") / F.col("n_bytes")
    typical = good.groupBy("lang").agg(F.percentile_approx(own, 0.5, 10000).alias("_typical"))
    mean = (PRIOR_BYTES * F.coalesce("_typical", own) - F.col("log_p")) / (F.col("n_bytes") + PRIOR_BYTES)
    typical = saved(typical, "typical")
    n = F.count("*")
    # uniform bytes only ever widen
    quantile = F.percentile_approx(mean, QUANTILE, 10000)
    limit = (n * quantile + UNIFORM_TEXTS * F.greatest(F.lit(math.log(256)), quantile)) / (n + UNIFORM_TEXTS)
    limits = _of_language(good, typical).groupBy("lang").agg((F.exp(limit) * ROOM).alias("_limit"))
    return (
        _of_language(_of_language(scored, typical), saved(limits, "limits"))
        .withColumns({"perplexity": F.round(F.exp(mean), 6), "threshold": F.round(F.coalesce("_limit", F.lit(math.inf)), 6)})
        .select("_id", "_h", "lang", "n_bytes", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))
    )


def _of_language(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows with the values of their language, null included; values (a row per language) are broadcast."""
    values = values.withColumnRenamed("lang", "_l")
    return rows.join(F.broadcast(values), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")

"""Removal of words in windows that an earlier document has, with a log-structured fingerprint index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packaudit.llm.anchors import SPAN, WORDS, Shape, anchor_rows, covered
from packaudit.llm.common import saved, scratch, slices, starts_of

#: Runs of the index that may stand side by side before they are merged into one.
RUNS = 2
#: Batches in which a whole table enters the index.
BATCHES = 2
#: Files into which a run is bucketed by its fingerprints.
BUCKETS = 32

ENTRY = "core long, ctx long, proof long, first long, n long"


class FingerprintIndex:
    """Immutable runs of (core, ctx, proof, first, n): fingerprints of windows seen, the smallest id and how many.

    A run is a table in shared storage, bucketed and sorted by the fingerprint, so that a merge
    join with a batch shuffles the batch only. Runs are never changed; when there are more than
    RUNS, they are merged into a new one. Which runs are current is written down beside them after
    each change, under a number that grows; open() takes the last list. A run that was written
    but isn't listed (a session that died) is passed over.
    """

    def __init__(self, spark: SparkSession, path: str, runs: list[str] | None = None, version: int = 0):
        self.spark, self.path, self.names, self.version = spark, path.rstrip("/"), list(runs or []), version
        self.tables: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that earlier sessions left at path; an empty one if there is none."""
        path = path.rstrip("/")
        lists = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/lists")
        if not lists.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(lists):
            return cls(spark, path)
        last = spark.read.schema("version long, runs array<string>").json(f"{path}/lists").orderBy(F.desc("version")).first()
        return cls(spark, path, last["runs"], last["version"])

    def _listed(self) -> None:
        self.version += 1
        row = self.spark.createDataFrame([(self.version, self.names)], "version long, runs array<string>")
        row.coalesce(1).write.mode("append").json(f"{self.path}/lists")

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        buckets = max(BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        (
            rows.select("core", "ctx", "proof", "first", "n")
            .repartition(buckets, "core", "ctx")
            .write.bucketBy(buckets, "core", "ctx")
            .sortBy("core", "ctx")
            .option("path", f"{self.path}/{name}-{buckets}")
            .option("compression", "zstd")
            .saveAsTable(name)
        )
        self.tables.append(name)
        return f"{name}-{buckets}"

    def run(self, name: str) -> DataFrame:
        """A run as a table of the session's catalog, with its buckets."""
        table, buckets = name.split("-")
        if table not in self.tables:
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({ENTRY}) USING parquet CLUSTERED BY (core, ctx) SORTED BY (core, ctx) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
            self.tables.append(table)
        return self.spark.table(table)

    @property
    def runs(self) -> list[DataFrame]:
        return [self.run(n) for n in self.names]

    def add(self, anchors: DataFrame) -> DataFrame:
        """Takes in a batch of anchor_rows(); returns (_id, _h, lo, hi, step, times) of its runs of windows that a document with a smaller id has as a whole.

        A match of fingerprints is verified by the digest of the words on both sides. Batches
        come in the order of ids, or, where ids don't grow, each is right about what came before.
        """
        new = anchors.groupBy("core", "ctx", "proof").agg(F.min("_id").alias("first"), F.sum("times").alias("n"))
        self.names.append(self._write(new))
        seen = []
        for run in self.runs:
            earlier = run.select("core", "ctx", F.col("proof").alias("_proof"), "first")
            match = anchors.join(earlier, ["core", "ctx"]).where(F.col("proof") == F.col("_proof"))
            seen.append(match.where(F.col("first") < F.col("_id")).select("_id", "_h", *SPAN))
        found = reduce(DataFrame.unionByName, seen)
        if len(self.names) > RUNS:
            found = saved(found, "seen")
            self.compact()
        else:
            self._listed()
        return found

    def compact(self) -> DataFrame:
        """All runs merged into one."""
        if len(self.names) > 1:
            rows = reduce(DataFrame.unionByName, self.runs)
            self.names = [self._write(rows.groupBy("core", "ctx", "proof").agg(F.min("first").alias("first"), F.sum("n").alias("n")))]
            self._listed()
        return self.run(self.names[0])

    def close(self) -> None:
        """Takes the runs' tables out of the session's catalog; their files stay."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []

    def late(self, batch: DataFrame, history: DataFrame, shape: Shape = WORDS) -> DataFrame:
        """Takes in a batch of units(); returns all of its runs of windows that a smaller id of the batch or of history has.

        history are the units() of all earlier batches: where surroundings differ, the words of
        the documents that the index names decide, window by window.
        """
        anchors = saved(anchor_rows(batch, shape, by_words=True), "anchors")
        # what the index has beside a core of the batch, before the batch is in it
        whole = saved(self.add(anchors), "seen")
        cores = saved(anchors.select("core").distinct(), "cores")
        known = reduce(DataFrame.unionByName, self.runs).groupBy("core", "ctx").agg(F.min("first").alias("first"))
        known = known.join(cores, "core", "left_semi")
        firsts = known.select(F.col("first").alias("_id")).distinct()
        old = saved(history.join(firsts, "_id", "left_semi"), "history")
        every = anchors.unionByName(anchor_rows(old, shape, by_words=True))
        found = _verified(batch.unionByName(old), saved(every, "anchors"), saved(known, "known"), shape)
        return whole.unionByName(found.join(batch.select("_id", "_h").distinct(), ["_id", "_h"], "left_semi"))


def seen_windows(rows: DataFrame, shape: Shape = WORDS, batches: int = BATCHES) -> DataFrame:
    """(_id, _h, lo, hi, step, times): runs of windows of words, by first and last start, that a smaller id has too. rows are units().

    The batches go through the index in the order of their ids. Runs with the same surroundings
    as an earlier one are settled by the merge join. Of the cores with several surroundings, one
    text for each (that with the smallest id) is fetched and each of its windows hashed from its
    words, to see which ones an earlier text has.
    """
    spark = rows.sparkSession
    cuts = rows.stat.approxQuantile("_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    index, seen, parts = FingerprintIndex(spark, scratch(spark, "fingerprints")), [], []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = rows
        batch = batch if low is None else batch.where(F.col("_id") > int(low))
        batch = batch if high is None else batch.where(F.col("_id") <= int(high))
        parts.append(saved(anchor_rows(batch, shape, by_words=True), "anchors"))
        seen.append(saved(index.add(parts[-1]), "seen"))
    anchors = reduce(DataFrame.unionByName, parts)
    found = saved(_verified(rows, anchors, index.compact(), shape), "verified")
    index.close()
    return reduce(DataFrame.unionByName, seen).unionByName(found)


#: Cores with more different surroundings than this are compared by Spark, window by window.
LARGE = 256


def _verified(rows: DataFrame, anchors: DataFrame, index: DataFrame, shape: Shape) -> DataFrame:
    several = saved(index.groupBy("core").agg(F.count("*").alias("k")).where("k > 1"), "cores")
    firsts = saved(index.join(several, "core").select("core", "ctx", "k", F.col("first").alias("_id")), "firsts")
    places = saved(anchors.join(firsts, ["core", "ctx", "_id"]).select("core", "k", "_id", "_h", *SPAN), "places")
    small = _hashed(rows, places.where(F.col("k") <= LARGE), shape).repartition("core").sortWithinPartitions("core")
    return small.mapInArrow(_late_in_groups, "_id long, _h long, lo int, hi int, step int, times int").unionByName(_late_windows(_hashed(rows, places.where(F.col("k") > LARGE), shape)))


def _hashed(rows: DataFrame, places: DataFrame, shape: Shape) -> DataFrame:
    """(core, _id, _h, lo, step, times, windows): 64-bit hashes of the words of all windows of each run, beside the core's."""
    by_text = places.groupBy("_id", "_h").agg(F.collect_set(F.struct("core", *SPAN)).alias("_runs"))
    digest = xxhash.xxh3_64_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out = []
            for i, h, runs, text in zip(batch.column(0), batch.column(1), batch.column(2), texts, strict=True):
                words, i, h = text.split(), i.as_py(), h.as_py()
                for r in runs.as_py():
                    lo, hi = r["lo"], r["hi"]
                    windows = b"".join([digest(b" ".join(words[s : s + shape.width])) for s in range(lo, hi + 1)])
                    out.append((r["core"], i, h, lo, r["step"], r["times"], windows))
            kinds = (*[pa.int64()] * 3, *[pa.int32()] * 3, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["core", "_id", "_h", "lo", "step", "times", "windows"])

    texts = by_text.join(rows, ["_id", "_h"]).select("_id", "_h", "_runs", "_t")
    return texts.mapInArrow(run, "core long, _id long, _h long, lo int, step int, times int, windows binary")


def _late_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by core: the windows that a row of the same core with a smaller id has."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cores = table.column("core").to_numpy()
        cut = int(np.searchsorted(cores, cores[-1])) if len(cores) else 0  # the last group may go on
        yield from _late(table.slice(0, cut))
        held = table.slice(cut).combine_chunks()
    if held is not None:
        yield from _late(held)


def _late(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    windows = table.column("windows").to_pylist()
    counts = np.array([len(w) // 8 for w in windows], np.int64)
    row = np.repeat(np.arange(len(windows)), counts)
    hashes = np.frombuffer(b"".join(windows), np.int64)
    core, ids = table.column("core").to_numpy()[row], table.column("_id").to_numpy()[row]
    order = np.lexsort((ids, hashes, core))
    head = np.ones(len(order), bool)
    head[1:] = (core[order][1:] != core[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    first = ids[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    late = np.sort(order[ids[order] > first])
    lo = table.column("lo").to_numpy()[row] + np.arange(len(row)) - starts_of(counts)[row]
    of = pa.array(row[late])
    starts = pa.array(lo[late].astype(np.int32))
    own = {c: table.column(c).combine_chunks().take(of) for c in ("_id", "_h", "step", "times")}
    yield pa.RecordBatch.from_arrays([own["_id"], own["_h"], starts, starts, own["step"], own["times"]], names=["_id", "_h", *SPAN])


def _late_windows(hashed: DataFrame) -> DataFrame:
    """The same for groups of any size, with a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("windows").to_pylist()
            counts = np.array([len(w) // 8 for w in windows], np.int64)
            row = np.repeat(np.arange(len(windows)), counts)
            lo = batch.column("lo").to_numpy()[row] + np.arange(len(row)) - starts_of(counts)[row]
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(of) for c in ("core", "_id", "_h", "step", "times")), pa.array(lo.astype(np.int32)), pa.array(np.frombuffer(b"".join(windows), np.int64))],
                names=["core", "_id", "_h", "step", "times", "lo", "window"],
            )

    every = hashed.mapInArrow(run, "core long, _id long, _h long, step int, times int, lo int, window long")
    first = every.groupBy("core", "window").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    late = every.join(first, ["core", "window"]).where(F.col("_first") < F.col("_id"))
    return late.select("_id", "_h", "lo", F.col("lo").alias("hi"), "step", "times")


def without_seen_windows(rows: DataFrame, shape: Shape = WORDS, batches: int = BATCHES) -> DataFrame:
    """(_id, _h, n_words, n_removed, kept) of each row of units(): kept has the words that are left, one space between.

    Texts with fewer than `shape.width` words have no window and stay. A null text has no words.
    Rows with the same id never take words from each other.
    """
    spans = seen_windows(rows, shape, batches).groupBy("_id", "_h").agg(F.collect_list(F.struct(*SPAN)).alias("_spans"))
    whole = rows.join(spans, ["_id", "_h"], "left").select("_id", "_h", "_t", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out: list[tuple] = []
            for i, h, text, spans in zip(batch.column(0), batch.column(1), texts, batch.column(3), strict=True):
                words = text.split()
                kept, end = [], 0
                for lo, hi in covered(spans.as_py() or [], shape.width):
                    kept += words[end:lo]
                    end = hi
                kept += words[end:]
                out.append((i.as_py(), h.as_py(), len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield _batch(out)

    return whole.mapInArrow(run, "_id long, _h long, n_words long, n_removed long, kept string")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["_id", "_h", "n_words", "n_removed", "kept"])

"""Best-fit packing by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packaudit.llm.bpe import token_pieces
from packaudit.llm.common import saved

#: Pieces of one length that one task ranks; more are dealt into parts by a salt, so that no length is one task's.
RANKED = 50_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the fullest bin that holds the largest available length.

    Bitset subset sums: bit s of a mask says that the lengths so far can fill s; each length's
    copies enter in powers of two. The walk over lengths ends as soon as the bin can be full.
    """
    sizes = sorted(counts, reverse=True)
    room = capacity - sizes[0]
    full, steps, mask = (1 << (room + 1)) - 1, [], 1
    for size in sizes:
        left, n = min(counts[size] - (size == sizes[0]), room // size), 1
        while left > 0 and not mask >> room:
            n = min(n, left)
            steps.append((size, n, mask))
            mask |= (mask << (size * n)) & full
            left -= n
            n *= 2
        if mask >> room:
            break
    at, take = mask.bit_length() - 1, {sizes[0]: 1}
    for size, n, before in reversed(steps):
        if not before >> at & 1:
            take[size] = take.get(size, 0) + n
            at -= size * n
    return take


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies per bin, first bin, offset) rows for all pieces.

    A combination is removed as often as its lengths last, so that each one uses up a length:
    there are at most as many combinations as lengths, whatever the number of pieces.
    """
    counts, rank, bins, rows = dict(counts), dict.fromkeys(counts, 0), 0, []
    while counts:
        take = fullest(counts, capacity)
        times, offset = min(counts[size] // n for size, n in take.items()), 0
        for size in sorted(take, reverse=True):
            n = take[size]
            rows.append((size, rank[size], rank[size] + n * times, n, bins, offset))
            rank[size] += n * times
            offset += size * n
            counts[size] -= n * times
            if not counts[size]:
                del counts[size]
        bins += times
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = 4096, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (with a `length` of 1 to capacity) with sequence_id and offset.

    A piece of the full capacity is a sequence of its own, with a negative number. Others rank
    inside their length in the order of a salt and the key; the plan says which ranks go to which
    place. Driver and broadcast see the plan only: its size depends on the capacity (at most that
    many lengths and combinations), not on the number of pieces. An empty table gives an empty
    result; repeated pieces are placed one by one.
    """
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    pieces = pieces.where(F.col("length") < capacity)
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = -(-max(totals.values(), default=1) // RANKED)
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "lengths")
    by_length: dict[int, list[tuple]] = {}
    for row in plan(totals, capacity):
        by_length.setdefault(row[0], []).append(row[1:])
    shared = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in by_length.items()})
    own = Window.partitionBy("length", "_salt").orderBy(*key)
    ranked = (
        pieces.withColumn("_own", F.row_number().over(own) - 1)
        .join(counts.select("length", "_salt", "_before"), ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_own"))
        .drop("_salt", "_own", "_before")
    )
    kept = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        for batch in batches:
            sizes, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            order = np.argsort(sizes, kind="stable")
            cuts = np.flatnonzero(np.diff(sizes[order])) + 1
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for group in np.split(order, cuts) if len(sizes) else []:
                size, rank = int(sizes[group[0]]), ranks[group]
                first, _, each, base, start = by[size]
                i = np.searchsorted(first, rank, "right") - 1
                sequence[group] = base[i] + (rank - first[i]) // each[i]
                offset[group] = start[i] + (rank - first[i]) % each[i] * size
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").unionByName(full)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Texts as token pieces (doc_id, piece, start, length, ids_crc32), packed into few sequences.

    A null or empty text is the single id `end_id`; only texts longer than the capacity are cut.
    """
    return pack_pieces(saved(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)

"""Removal of every byte of a long string that occurs again, and of passages of words, by suffix arrays over groups of windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.llm.anchors import BYTES, SPAN, Shape, anchor_rows, covered, word_places, word_values
from packaudit.llm.common import dropped, saved, slices
from packaudit.llm.suffix_array import common_prefixes, suffix_array

#: Different surroundings of one core that a suffix array takes; larger groups are divided first.
LARGE = 1_000
#: Windows that begin so close together are taken together when a group is divided, ever fewer of them.
BANDS = (64, 16, 4, 1)
#: Surroundings that one suffix array takes together, whole groups at a time.
TOGETHER = 4_000
#: Stands for "no byte here"; UTF-8 has no such byte.
NONE = 0xFF
#: Bytes of a word's code; a window of `width` bytes of codes is one of width / CODE words (BYTES: 50).
CODE = 8


def with_codes(text: bytes) -> bytes:
    """The text and behind it a code of each of its words: strings of codes are passages of words, however they are spaced."""
    data = np.frombuffer(text, np.uint8)
    return text + word_values(data, *word_places(data)).tobytes()


def repeated_spans(rows: DataFrame, shape: Shape = BYTES, view: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(_id, _h, lo, hi, step, times): runs of windows of `shape.width` bytes, by first and last start, that occur elsewhere too.

    rows are units(). Runs whose whole surroundings occur twice are known from counts alone;
    of the other groups with a repeated core, the surroundings are fetched once for each different
    one and go to suffix arrays, whole groups at a time. Groups that are too large for a task are
    divided by what bands of their windows share, until they aren't. With view, the bytes are
    those that it makes of a text.
    """
    anchors = saved(anchor_rows(rows, shape, by_words=False, view=view).drop("proof"), "anchors")
    cores = saved(anchors.groupBy("core").agg(F.sum("times").alias("_n")).where("_n > 1").select("core"), "cores")
    hits = saved(anchors.join(cores, "core"), "hits")
    dropped(anchors, cores)
    first = F.min(F.struct("_id", "_h", "lo", "hi", "anchor")).alias("_first")
    kinds = hits.groupBy("core", "ctx").agg(F.sum("times").alias("n"), first)
    per_core = kinds.groupBy("core").agg(F.count("*").alias("k"), F.min("n").alias("_least"))
    kinds = saved(kinds.join(per_core, "core"), "kinds")
    parts = [hits.join(kinds.where("n > 1").select("core", "ctx"), ["core", "ctx"]).select("_id", "_h", *SPAN)]
    # where all surroundings occur twice, nothing is left to find
    rest = kinds.where("k > 1 and _least = 1").select("core", "n", "k", "_first.*")
    groups = saved(surroundings(rows, rest, shape, view), "surroundings")
    for band in BANDS:
        small = groups.where(F.col("k") <= LARGE).repartition("core").sortWithinPartitions("core")
        parts.append(_once(small.drop("k").mapInArrow(_in_small_groups(shape), RUN)))
        found, groups = divided(groups.where(F.col("k") > LARGE), band, shape)
        parts.append(_once(found))
    return reduce(DataFrame.unionByName, parts)


RUN = "_id long, _h long, lo int, hi int"


def _once(runs: DataFrame) -> DataFrame:
    return runs.withColumns({"step": F.lit(0), "times": F.lit(1)})


def divided(groups: DataFrame, band: int, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """(runs known to occur elsewhere, smaller groups in the form of surroundings()).

    The windows of a row are taken in bands of `band` neighbouring starts. If the bytes that all
    windows of a band share are in no other row, none of them is; if all their bytes together are,
    all are. What neither holds for is left: rows that share the first, one for each different
    second, are a group. With one window to a band, nothing is left.
    """
    width = shape.width - shape.core
    names = ["core", "outer", "n", "_id", "_h", "lo", "hi", "anchor", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, key = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            out: list[tuple] = []
            for core, n, i, h, lo, hi, at, left, right in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                low, high, own = at - hi, at - lo, core.to_bytes(8, "little", signed=True)
                for number in range(low // band, high // band + 1):
                    # these windows begin between `near` and `far` bytes before the anchor
                    near, far = number * band, number * band + band - 1
                    inner = left[len(left) - near :] + right[: max(0, width - far)]
                    near, far = max(low, near), min(high, far)
                    before, behind = left[len(left) - far :] if far else b"", right[: width - near]
                    outer = digest(before + behind, far) - (1 << 63)
                    inner = int.from_bytes(key(own + inner, number)[:8], "little", signed=True)
                    out.append((inner, outer, n, i, h, at - far, at - near, at, before, behind))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    fields = "core long, outer long, n long, _id long, _h long, lo int, hi int, anchor int, left binary, right binary"
    banded = saved(groups.select(_NAMES).mapInArrow(run, fields), "bands")
    first = F.min(F.struct("_id", "_h", "lo", "hi", "anchor", "left", "right")).alias("_first")
    kinds = banded.groupBy("core", "outer").agg(F.sum("n").alias("_n"), first)
    per_core = kinds.groupBy("core").agg(F.count("*").alias("k"), F.min("_n").alias("_least"), F.sum("_n").alias("_all"))
    kinds = saved(kinds.join(per_core.where("_all > 1"), "core"), "kinds")
    found = banded.where("n = 1").join(kinds.where("_n > 1").select("core", "outer"), ["core", "outer"]).select("_id", "_h", "lo", "hi")
    left = kinds.where("k > 1 and _least = 1").select("core", F.col("_n").alias("n"), "k", "_first.*")
    return found, left


def surroundings(rows: DataFrame, rest: DataFrame, shape: Shape, view: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(core, n, k, _id, _h, lo, hi, anchor, left, right): bytes before and behind the core of each run in rest."""
    by_text = rest.groupBy("_id", "_h").agg(F.collect_list(F.struct("core", "n", "k", "lo", "hi", "anchor")).alias("_runs"))
    texts = by_text.join(rows, ["_id", "_h"]).select("_id", "_h", "_runs", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in slices(batches):
            for i, h, runs, text in zip(batch.column(0), batch.column(1), batch.column(2), own, strict=True):
                out, i, h = [], i.as_py(), h.as_py()
                text = view(text) if view else text
                for r in runs.as_py():
                    at, lo, end = r["anchor"], r["lo"], r["hi"] + shape.width
                    out.append((r["core"], r["n"], r["k"], i, h, lo, r["hi"], at, text[lo:at], text[at + shape.core : end]))
                kinds = (*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*_NAMES[:2], "k", *_NAMES[2:]])

    return texts.mapInArrow(run, "core long, n long, k long, _id long, _h long, lo int, hi int, anchor int, left binary, right binary")


_NAMES = ["core", "n", "_id", "_h", "lo", "hi", "anchor", "left", "right"]


def _in_small_groups(shape: Shape):
    """Batches that are sorted by core to the spans that occur in another row of the same core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                table = pa.Table.from_batches(held)
                cores = table.column("core").to_numpy()
                cut = int(np.flatnonzero(cores == cores[-1])[0])  # the last group may go on
                yield from spans(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from spans(pa.Table.from_batches(held))

    def spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = 0
        cores = table.column("core").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(cores)) + 1, len(cores))
        while at < len(cores):
            over = ends[(ends > at) & (ends <= at + TOGETHER)]
            stop = int(over[-1]) if len(over) else int(ends[ends > at][0])
            yield from _compared(table.slice(at, stop - at), shape)
            at = stop

    return run


def _matrix(column: pa.ChunkedArray, width: int, backward: bool) -> np.ndarray:
    out = np.full((len(column), width), NONE, np.uint8)
    for i, data in enumerate(column.to_pylist()):
        if data:
            row = np.frombuffer(data, np.uint8)
            out[i, : len(row)] = row[::-1] if backward else row
    return out


def _classes(group: np.ndarray, matrix: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each group: the columns before which some of its rows part (ascending), and each row's
    class up to the end of each block between such columns (rows x blocks); equal classes, equal bytes."""
    rows, width = matrix.shape
    keyed = np.concatenate([group.astype(">u4").view(np.uint8).reshape(rows, 4), matrix], axis=1)
    order = np.argsort(keyed.view(f"S{width + 4}").ravel(), kind="stable")
    ordered = matrix[order]
    differ = ordered[1:] != ordered[:-1]
    part = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    columns, classes = [], []
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, rows)
    start = 0
    for end in ends.tolist():
        inner = part[start : end - 1]
        cuts = np.unique(inner[inner < width])
        stops = np.append(cuts[1:], width) if len(cuts) else np.empty(0, np.int64)
        # a new class begins where neighbours part before the block ends
        new = inner[:, None] < stops[None, :]
        own = np.zeros((end - start, len(stops)), np.int64)
        own[1:] = np.cumsum(new, axis=0)
        back = np.empty_like(own)
        back[order[start:end] - start] = own
        columns.append(cuts)
        classes.append(back)
        start = end
    return columns, classes


def _compared(table: pa.Table, shape: Shape) -> Iterator[pa.RecordBatch]:
    """One suffix array over the rows of some whole groups, in order of their cores.

    A row becomes a short sequence: its left blocks from the outermost in, its core, its right
    blocks and an end of its own. Blocks lie between the columns where rows of the group part, so
    rows share a suffix of these symbols exactly as far as they share bytes. A suffix that begins
    with a left block stands for all windows that start in the block; neighbours in the suffix
    array share most with it, and that decides which of these windows occur twice.
    """
    core = table.column("core").to_numpy()
    group = np.cumsum(np.append(0, np.diff(core) != 0)) if len(core) else np.empty(0, np.int64)
    reach = shape.reach - 1
    left_cuts, left = _classes(group, _matrix(table.column("left"), reach, True))
    right_cuts, right = _classes(group, _matrix(table.column("right"), reach, False))
    n, lo, hi, at = (table.column(c).to_numpy() for c in ("n", "lo", "hi", "anchor"))
    symbols: list[int] = []
    places: list[tuple[int, int, int]] = []  # (place in symbols, row, block or -1 for the core)
    names: dict[tuple, int] = {}
    first = np.searchsorted(group, np.arange(len(left)))
    for row in range(len(core)):
        g = int(group[row])
        l, r = left[g][row - first[g]], right[g][row - first[g]]
        for block in range(len(l) - 1, -1, -1):
            places.append((len(symbols), row, block))
            symbols.append(names.setdefault((g, 0, block, int(l[block])), len(names)))
        places.append((len(symbols), row, -1))
        symbols.append(names.setdefault((g, 1), len(names)))
        symbols += [names.setdefault((g, 2, block, int(c)), len(names)) for block, c in enumerate(r.tolist())]
        symbols.append(names.setdefault((row,), len(names)))
    text = np.array(symbols, np.int64) + 1
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    best = np.zeros(len(text), np.int64)
    best[order] = np.maximum(shared, np.append(shared[1:], 0))
    out: list[tuple[int, int, int]] = []
    for place, row, block in places:
        if n[row] > 1:
            continue  # occurs as a whole
        g = int(group[row])
        k = int(best[place]) - (block + 2)  # right blocks that another row shares
        if k < 0:
            continue
        cuts, stops = left_cuts[g], right_cuts[g]
        equal = shape.core + (int(stops[k]) if k < len(stops) else reach)
        # windows that begin `back` bytes before the anchor
        outer = at[row] - lo[row]
        if block >= 0:
            inner = int(cuts[block]) + 1
            outer = min(outer, int(cuts[block + 1]) if block + 1 < len(cuts) else reach)
        else:
            inner = 0
            outer = min(outer, int(cuts[0]) if len(cuts) else reach)
        inner = max(inner, at[row] - hi[row], shape.width - equal)
        if inner <= outer:
            out.append((row, int(at[row] - outer), int(at[row] - inner)))
    if out:
        rows = pa.array([r for r, _, _ in out])
        yield pa.RecordBatch.from_arrays(
            [
                table.column("_id").combine_chunks().take(rows),
                table.column("_h").combine_chunks().take(rows),
                pa.array([a for _, a, _ in out], pa.int32()),
                pa.array([b for _, _, b in out], pa.int32()),
            ],
            names=["_id", "_h", "lo", "hi"],
        )


def stripped(rows: DataFrame, shape: Shape = BYTES, whole_characters: bool = False, passages: bool = False) -> DataFrame:
    """(_id, _h, n_bytes, n_removed, n_spans, kept) of each row of units(): kept has the bytes that are left.

    With whole_characters, a character stays if one of its bytes does. With passages, each word
    of a window of width / CODE words that occurs again goes too, with the white space between such
    words. A null text counts as empty; a text that is shorter than a string to look for stays as
    it is. Repeated rows are other places: from 400 bytes on, they lose everything.
    """
    spans = repeated_spans(rows, shape, with_codes if passages else None).groupBy("_id", "_h").agg(F.collect_list(F.struct(*SPAN)).alias("_spans"))
    whole = rows.join(spans, ["_id", "_h"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out: list[tuple] = []
            for i, h, data, found in zip(batch.column(0), batch.column(1), texts, batch.column(3), strict=True):
                found, words = found.as_py() or [], []
                if passages:
                    found, words = _told_apart(found, len(data), shape.width)
                gone = covered(found, shape.width)
                if whole_characters:
                    gone = [x for x in (_characters(data, *g) for g in gone) if x[0] < x[1]]
                if words:
                    starts, ends = word_places(np.frombuffer(data, np.uint8))
                    gone = _merged([*gone, *([int(starts[a]), int(ends[b - 1])] for a, b in covered(words, shape.width // CODE))])
                at, kept = 0, []
                for lo, hi in gone:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                out.append((i.as_py(), h.as_py(), len(data), sum(b - a for a, b in gone), len(gone), b"".join(kept)))
            yield _batch(out)

    return whole.select("_id", "_h", "_t", "_spans").mapInArrow(run, "_id long, _h long, n_bytes long, n_removed long, n_spans long, kept binary")


def _told_apart(spans: list[dict], size: int, width: int) -> tuple[list[dict], list[dict]]:
    """Spans of with_codes() of a text of `size` bytes: those of its bytes, and those of its words by first words.

    Windows that lie in both the text and the codes, or that begin inside a code, are no strings.
    """
    found, words = [], []
    for s in spans:
        lo, hi, step, times = (s[c] for c in SPAN)
        if times > 1 and (step % CODE or lo < size < lo + (times - 1) * step + hi - lo + width):
            ones = [(lo + k * step, hi + k * step, 0, 1) for k in range(times)]
        else:
            ones = [(lo, hi, step, times)]
        for lo, hi, step, times in ones:
            if lo >= size or hi >= size:
                first, last = -(-max(0, lo - size) // CODE), (hi - size) // CODE
                if first <= last:
                    words.append({"lo": first, "hi": last, "step": step // CODE, "times": times})
            if lo <= min(hi, size - width):
                found.append({"lo": lo, "hi": min(hi, size - width), "step": step, "times": times})
    return found, words


def _merged(stretches: list[list[int]]) -> list[list[int]]:
    """Sorted disjoint stretches that cover these."""
    return covered([{"lo": a, "hi": b, "step": 0, "times": 1} for a, b in stretches], 0)


def _characters(data: bytes, lo: int, hi: int) -> list[int]:
    """The part of a stretch of bytes that consists of whole characters."""
    while lo < hi and data[lo] & 0xC0 == 0x80:
        lo += 1
    while lo < hi < len(data) and data[hi] & 0xC0 == 0x80:
        hi -= 1
    return [lo, hi]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["_id", "_h", "n_bytes", "n_removed", "n_spans", "kept"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

"""Content-defined anchors: which windows of a text to compare with which others.

A window is `width` consecutive units (words, bytes) of one text. Its anchor is the place, among
the first `reach` places of the window, where the hash of the next `gram` units is smallest
(the first of several). That depends on nothing outside the window, so equal windows have their
anchors at the same place in them, and neighbouring windows share anchors: a text has about
2 / reach anchors a unit, each with a run of windows. Two windows can only be equal if the
`core` of width - reach + 1 units from their anchors on is the same, and they are equal if
everything from the first to the last window of their runs is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from packaudit.llm.common import SLICE_BYTES, slices, starts_of

#: Units of a text that are handled as one; longer texts go in overlapping segments.
SEGMENT = 4_000_000


@dataclass(frozen=True)
class Shape:
    width: int
    reach: int
    gram: int

    @property
    def core(self) -> int:
        return self.width - self.reach + 1


WORDS = Shape(width=50, reach=36, gram=8)
BYTES = Shape(width=400, reach=256, gram=32)

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, 2^bits of each."""
    n = 1 << bits
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = _powers(max(20, len(values).bit_length()))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        k = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:k]) * self.down[:k]) if k > 0 else np.empty(0, np.uint64)


def runs(values: np.ndarray, lengths: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(segment, anchor, first window, last window, hash of the core) of each run; places count from the segment's start."""
    starts = starts_of(lengths)
    rolling = Rolling(values)
    grams = rolling.grams(shape.gram)
    if len(grams) < shape.reach:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    low = np.uint64((1 << len(values).bit_length()) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < shape.reach:
        step = min(span, shape.reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    windows = np.maximum(lengths - shape.width + 1, 0)
    total = int(windows.sum())
    at = np.arange(total) + np.repeat(starts[:-1] - starts_of(windows)[:-1], windows)
    anchor = (least[at] & low).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], total)[: len(first)] - 1
    segment = np.searchsorted(starts, at[first], "right") - 1
    # empty segments share their start with the next one
    anchor, origin = anchor[first], starts[segment]
    return segment, anchor - origin, at[first] - origin, at[last] - origin, rolling.of(anchor, anchor + shape.core)


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes outside 0x20 and 0x09-0x0D) of a text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value of each word."""
    if not len(starts):
        return np.empty(0, np.uint64)
    return Rolling(data.astype(np.uint64) + np.uint64(1)).of(starts, ends)


def joined_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined by \\n: the bytes, starts and ends of words, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_places(data)
    begins = starts_of(np.array([len(t) + 1 for t in texts], np.int64))
    return data, starts, ends, np.diff(np.searchsorted(starts, begins))


def _pieces(sizes: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first unit, units) of the segments that cover all windows of texts with these sizes."""
    out = [(i, s, min(SEGMENT + shape.width - 1, n - s)) for i, n in enumerate(sizes.tolist()) for s in range(0, max(1, n - shape.width + 1), SEGMENT)]
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True))


def _progressions(text: np.ndarray, key: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, step, times): rows that come back in a text at equal distances, as one.

    Rows of one text with one key, in the order of their places, are cut where their distance
    changes. A text of one letter or of a short pattern has a few rows then, not one a byte.
    """
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    if same.any():
        order = np.lexsort((lo, key, text))
        same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
        distance = np.diff(lo[order])
        new[1:] = ~same
        # the third and later of a key begin anew where the distance changes
        third = same[1:] & same[:-1]
        new[2:] |= third & (distance[1:] != distance[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(order)))
    step = np.zeros(len(starts), np.int64)
    several = times > 1
    step[several] = lo[order[starts[several] + 1]] - lo[order[starts[several]]]
    return order[starts], step, times


def anchor_rows(rows: DataFrame, shape: Shape, by_words: bool, view: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(_id, _h, core, ctx, proof, anchor, lo, hi, step, times) of all runs of windows of the texts _t.

    core hashes the units that all windows of the run share; ctx and proof are a 128-bit digest of
    all units (words: their bytes) from the first to the last window and the anchor's place in
    them. lo and hi are the first units of the run's first and last window. The same run is at
    lo + step, lo + 2 * step and so on, `times` in all. With view, the units are the bytes that it
    makes of a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=SLICE_BYTES // (2 if view else 1)):
            if view:
                texts = [view(t) for t in texts]
            if by_words:
                data, starts, ends, sizes = joined_words([b" ".join(t.split()) for t in texts])
                values = word_values(data, starts, ends)
            else:
                data = np.frombuffer(b"".join(texts), np.uint8)
                values = data.astype(np.uint64) + np.uint64(1)
                sizes = np.array([len(t) for t in texts], np.int64)
            text, skip, n = _pieces(sizes, shape)
            begins = starts_of(sizes)[text] + skip
            if len(text) > len(texts):  # segments overlap
                values = np.concatenate([values[b : b + k] for b, k in zip(begins.tolist(), n.tolist(), strict=True)])
            segment, anchor, lo, hi, core = runs(values, n, shape)
            begin, end = begins[segment] + lo, begins[segment] + hi + shape.width
            if by_words and len(begin):
                begin, end = starts[begin], ends[end - 1]
            raw, digest = memoryview(data).cast("B"), xxhash.xxh3_128_digest
            digests = b"".join([digest(raw[b:e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
            ctx, proof = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
            ctx = mixed(ctx + (anchor - lo).astype(np.uint64))
            of, offset = text[segment], skip[segment]
            first, step, times = _progressions(of, ctx ^ core, lo + offset)
            to = pa.array(of[first])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(to),
                    batch.column(1).take(to),
                    *(pa.array(np.ascontiguousarray(x[first]).view(np.int64)) for x in (core, ctx, proof)),
                    *(pa.array((x + offset)[first].astype(np.int32)) for x in (anchor, lo, hi)),
                    pa.array(step.astype(np.int32)),
                    pa.array(times.astype(np.int32)),
                ],
                names=["_id", "_h", "core", "ctx", "proof", "anchor", "lo", "hi", "step", "times"],
            )

    return rows.select("_id", "_h", "_t").mapInArrow(run, "_id long, _h long, core long, ctx long, proof long, anchor int, lo int, hi int, step int, times int")


#: A span as a row of any of these tables has it, and as collected for a text.
SPAN = ["lo", "hi", "step", "times"]


def covered(spans: list[dict], width: int) -> list[list[int]]:
    """Sorted disjoint stretches [start, end) of units that windows with these first starts cover."""
    every: list[tuple[int, int]] = []
    for s in spans:
        lo, end, step, times = s["lo"], s["hi"] + width, s["step"], s["times"]
        if times > 1 and step <= end - lo:
            every.append((lo, end + step * (times - 1)))
        else:
            every += [(lo + k * step, end + k * step) for k in range(times)]
    out: list[list[int]] = []
    for lo, end in sorted(every):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return out

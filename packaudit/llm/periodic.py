"""Runs of periodically repeated words, found by block convolution with an exact number-theoretic transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.llm.common import slices, starts_of

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
#: A run has at least so many words, and at least two periods.
LEAST = 12
#: Transforms are over the integers modulo this prime, which has roots of unity of every order up to 65,536.
PRIME, ROOT = 65_537, 3
#: Words of a block at most; longer periods have blocks farther apart, not longer ones.
BLOCK = 32
#: Blocks whose convolutions are computed together.
TOGETHER = 4_096


def transform(length: int, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of this length (a power of two) as a matrix.

    Products with it are exact in floats: length * PRIME ** 2 is under 2 ** 53.
    """
    root = pow(ROOT, (PRIME - 1) // length, PRIME)
    powers = [pow(root, (-k if inverse else k) % length, PRIME) for k in range(length)]
    scale = pow(length, -1, PRIME) if inverse else 1
    at = np.arange(length)
    return (np.array(powers)[at[:, None] * at % length] * scale % PRIME).astype(float)


_MATRICES = {(4 * b, inverse): transform(4 * b, inverse) for b in (2, 4, 8, 16, BLOCK) for inverse in (False, True)}


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo PRIME, of each block with the stretches of its window that begin at 0, 1, ..."""
    n, b = blocks.shape
    length, offsets = 4 * b, windows.shape[1] - b + 1
    ahead, back = _MATRICES[length, False], _MATRICES[length, True]
    reverse = np.zeros((n, length))
    reverse[:, -np.arange(b) % length] = blocks
    wide = np.zeros((n, length))
    wide[:, : windows.shape[1]] = windows
    cross = ((reverse @ ahead) % PRIME * ((wide @ ahead) % PRIME) % PRIME @ back)[:, :offsets] % PRIME
    squares = np.cumsum(np.pad(windows.astype(np.int64) ** 2, ((0, 0), (1, 0))), axis=1)
    own = (blocks.astype(np.int64) ** 2).sum(1)
    return (own[:, None] + squares[:, b:] - squares[:, :-b] - 2 * cross.astype(np.int64)) % PRIME


def seeds(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, distances, length) for each scale of distances, ascending: blocks of words that come again so many words later.

    words: numbers of words, equal where the words are; longest: words of the longest text. A run
    with period q has a stretch of max(q, LEAST - q) words at least that comes again q words
    later, and such a stretch holds a whole block of its scale: for periods of 1 to 6 one of
    the blocks of two words, for 2b - 1 to 4b - 2 one of b. Beyond BLOCK words the blocks stay
    as long and lie b apart. A block is looked up only if each of its words comes again within
    the scale's greatest distance; without that it can't come again there itself.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    again = np.full(n, n)
    twins = words[order[1:]] == words[order[:-1]]
    again[order[:-1][twins]] = np.diff(order)[twins]
    values = words * 40_503 % PRIME
    scale = 2
    while True:
        low, high = (1, 6) if scale == 2 else (2 * scale - 1, 4 * scale - 2)
        if 2 * low > longest:
            return
        size = min(scale, BLOCK)
        starts = np.arange(0, max(0, n - size + 1), scale)
        for j in range(size):
            starts = starts[again[starts + j] <= high]
        found = [_matches(words, values, starts, first, min(high, max(6, first + 2 * size - 1)), size) for first in range(low, high + 1, max(6, 2 * size))]
        yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), size
        scale *= 2


def _matches(words: np.ndarray, values: np.ndarray, starts: np.ndarray, first: int, last: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, distances) of the blocks of `size` words that come again at a distance from first to last."""
    n, out = len(words), [(starts[:0], starts[:0])]
    for i in range(0, len(starts), TOGETHER):
        own = starts[i : i + TOGETHER]
        at = own[:, None] + np.arange(first, last + size)
        blocks = own[:, None] + np.arange(size)
        which, distance = np.nonzero(mismatches(values[blocks], values[np.minimum(at, n - 1)]) == 0)
        found, distance = own[which], distance + first
        fits = found + distance + size <= n
        found, distance = found[fits], distance[fits]
        # a sum may be a multiple of the prime: the words decide
        same = (words[found[:, None] + np.arange(size)] == words[(found + distance)[:, None] + np.arange(size)]).all(1)
        out.append((found[same], distance[same]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _equal_until(words: np.ndarray, at: int, q: int, step: int) -> int:
    """The first place from `at`, up (step 1) or down (-1), whose word isn't that of q places later."""
    n, size = len(words), 64
    while True:
        if step > 0:
            a, b = at, min(n - q, at + size)
        else:
            a, b = max(0, at + 1 - size), at + 1
        if a >= b:
            return at
        different = np.flatnonzero(words[a:b] != words[a + q : b + q])
        if len(different):
            return a + int(different[0] if step > 0 else different[-1])
        at, size = (b if step > 0 else a - 1), 2 * size


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of every run, by start, then period.

    Distances are taken in ascending order. A block inside a known run whose period divides its
    distance belongs to that run; any other one is extended to both sides, and where what
    is found has two periods and LEAST words, its distance is its smallest period.
    """
    known: list[tuple[int, int, int]] = []
    for starts, distances, size in seeds(words, longest):
        order = np.argsort(starts, kind="stable")
        starts, distances = starts[order], distances[order]
        ends = starts + distances + size
        left = np.ones(len(starts), bool)

        def cover(start: int, end: int, period: int, starts=starts, distances=distances, ends=ends, left=left) -> None:
            a, b = np.searchsorted(starts, (start, end))
            left[a:b] &= (distances[a:b] % period != 0) | (ends[a:b] > end)

        if len(starts):
            for run in known:
                cover(*run)
        by_distance = np.lexsort((starts, distances))
        for i in by_distance[left[by_distance]].tolist():
            if not left[i]:
                continue
            at, q = int(starts[i]), int(distances[i])
            low, high = _equal_until(words, at - 1, q, -1) + 1, _equal_until(words, at + size, q, 1)
            if high - low >= max(q, LEAST - q):
                known.append((low, high + q, q))
                cover(*known[-1])
    return np.array(sorted(known, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) for each row of docs.

    A run is a stretch of words with a smallest period q (words q apart are equal), of LEAST words
    and two periods at least, that no neighbouring word extends; start counts words from 0. runs
    is ordered by start, then period. collapsed holds the words, joined by one space, without
    those that lie behind the first q words of a run. Words are what stands between white space,
    unchanged. A null or empty text has none; repeated rows and null ids stay as they are, other
    columns are left out, an empty table gives none. A task holds the words of about a megabyte of
    texts, or of one longer text.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            split = [t.split() for t in texts]
            first = starts_of(np.array([len(w) for w in split], np.int64))
            numbers = np.empty(int(first[-1]), np.int64)
            named = 0
            for own, a in zip(split, first.tolist(), strict=False):
                names = {w: i for i, w in enumerate(dict.fromkeys(own), named)}
                numbers[a : a + len(own)] = np.fromiter(map(names.__getitem__, own), np.int64, len(own))
                named += len(names)
            found = runs(numbers, int(np.diff(first).max(initial=0)))
            of = np.searchsorted(first, found[:, 0], side="right") - 1
            kept = np.ones(len(numbers), bool)
            for start, end, period in found.tolist():
                kept[start + period : end] = False
            collapsed = []
            for own, a, b in zip(split, first[:-1].tolist(), first[1:].tolist(), strict=True):
                collapsed.append(b" ".join(own if kept[a:b].all() else [w for w, k in zip(own, kept[a:b].tolist(), strict=True) if k]))
            offsets = np.searchsorted(of, np.arange(len(split) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(c) for c in (found[:, 0] - first[of], found[:, 1] - found[:, 0], found[:, 2])], fields=list(SPANS.value_type))
            columns = [batch.column(0), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(offsets), spans, type=SPANS), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")

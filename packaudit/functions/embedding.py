"""The hook for embeddings of the user's own: batches to a provider that a worker loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """What a user supplies: the name of its space, the length of its vectors, and vectors for texts."""

    space: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


#: Providers that this worker process has loaded, by space.
_LOADED: dict[str, Provider] = {}


def _provider(load: Callable[[], Provider], space: str, dimension: int) -> Provider:
    if space not in _LOADED:
        made = load()
        if (made.space, made.dimension) != (space, dimension):
            raise ValueError(f"the provider is of {made.space} with {made.dimension} places, not of {space} with {dimension}")
        _LOADED[space] = made
    return _LOADED[space]


def batches(texts: list[str], most: int, most_bytes: int) -> Iterator[list[str]]:
    """Texts in their order, at most `most` together and at most most_bytes of UTF-8 (one text at least)."""
    out, size = [], 0
    for t in texts:
        n = len(t.encode())
        if out and (len(out) >= most or size + n > most_bytes):
            yield out
            out, size = [], 0
        out.append(t)
        size += n
    if out:
        yield out


def embedded(texts: DataFrame, load: Callable[[], Provider], space: str, dimension: int, most: int = 64, most_bytes: int = 1 << 20) -> DataFrame:
    """(id, embedding_space, embedding array<float>) of texts (id string, text string).

    load() is called once in a worker process. A null text is an empty one. A provider of another
    space or dimension, or one that gives too few vectors or vectors of another length, is an error.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = _provider(load, space, dimension)
        for part in parts:
            vectors: list[list[float]] = []
            said = [t or "" for t in part.column(1).to_pylist()]
            for some in batches(said, most, most_bytes):
                got = provider.embed(some)
                if len(got) != len(some) or any(len(v) != dimension for v in got):
                    raise ValueError(f"{space} gave {len(got)} vectors for {len(some)} texts, or not {dimension} places each")
                vectors += got
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

    rows = texts.select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "id string, embedding array<float>")
    return found.select("id", F.lit(space).alias("embedding_space"), "embedding")


def same_space(a: str, b: str) -> Column:
    """The condition that two columns' vectors can be compared."""
    return F.col(f"{a}.embedding_space") == F.col(f"{b}.embedding_space")

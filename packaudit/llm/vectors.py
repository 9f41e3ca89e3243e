"""What the vector searches share: integer vectors, shards of rows, blocks of queries, tiles of both."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block, about: what a task holds at a time.
SHARD_ROWS, BLOCK_QUERIES = 8_192, 1_024
#: Components become floor(SCALE * x).
SCALE = 256


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **more: Column) -> DataFrame:
    """(id, vec array<long>, more): usable rows, one for each id.

    Rows with a null id or vector, with a null or non-finite component, or with null in one of
    `more` take no part. Repeated rows count once; of different rows with one id, the one whose
    vector (then `more`) is smallest counts. Other columns are left out.
    """
    vec = F.col(vec_col)
    whole = rows.where(F.col(id_col).isNotNull() & vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    made = whole.select(F.col(id_col).cast("long").alias("id"), F.struct(F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE)).alias("vec"), *[c.alias(n) for n, c in more.items()]).alias("_row"))
    for n in more:
        made = made.where(F.col(f"_row.{n}").isNotNull())
    return made.groupBy("id").agg(F.min("_row").alias("_row")).select("id", "_row.*")


def parts(n: int, size: int) -> int:
    return max(1, -(-n // size))


def tiles(left: DataFrame, right: DataFrame, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (shard, block): each block of `left` meets each shard of `right` in one task."""
    left = left.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    return (
        left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))),
        right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))),
    )


def column(table: pa.Table, name: str) -> pa.Array:
    """The column as one array."""
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as its values in a row, and how many of them each row has."""
    c = column(table, name)
    return np.asarray(c.flatten()), np.diff(np.asarray(c.offsets))


def matrix(table: pa.Table, name: str = "vec", width: int = 0) -> np.ndarray:
    """A column of vectors as rows; shorter ones end in zeros."""
    values, sizes = lists(table, name)
    out = np.zeros((len(sizes), max(width, sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact: through floats where all sums fit 53 bits, else as 64-bit integers."""
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T

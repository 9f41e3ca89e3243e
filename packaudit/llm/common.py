"""What the operators of this subpackage share: scratch tables, unit rows, Arrow batches."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packaudit.functions.scratch import MADE, saved, scratch  # noqa: F401  the operators take them from here

#: Bytes of text that a task turns into arrays at a time.
SLICE_BYTES = 1_000_000


#: Scratch paths that stages of a pipeline made.
_OF_STAGES: list[str] = []


@contextlib.contextmanager
def stage_scratch(docs: DataFrame) -> Iterator[None]:
    """Around a pipeline's stage: what earlier stages put into the scratch folder goes, but for what docs reads.

    Earlier stages' rows are written when the next stage begins, so nothing else needs it.
    """
    used = {f.rpartition("/")[0] for f in docs.inputFiles()}
    left = [p for p in _OF_STAGES if any(u.endswith(p.rpartition("/")[2]) for u in used)]
    removed(docs.sparkSession, [p for p in _OF_STAGES if p not in left])
    _OF_STAGES[:] = left
    before = len(MADE)
    yield
    _OF_STAGES.extend(MADE[before:])


def removed(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders of the scratch folder."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables from saved() that nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, {f.rpartition("/")[0] for f in table.inputFiles()})


#: Stands for a null id: larger than others.
NO_ID = (1 << 63) - 1


def real_id(column: str = "_id") -> Column:
    """The id as it was in the table."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _id and _h: the id (null: the largest id) and a hash of the text (null: empty).

    The two are the key of joins: repeated rows agree in every result, and rows that share an id
    but not the text stay apart.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.withColumns({"_id": F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), "_h": F.xxhash64(text)})


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (_id, _h, _t): keys as in keyed(), and the text with null as empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_t"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _id, _h): all columns of docs as one struct, beside the key, so that no names clash."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return rows.select(
        "_row",
        F.coalesce(F.col("_row")[id_col].cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col("_row")[text_col].cast("string"), F.lit(""))).alias("_h"),
    )


def table(sf_dir: str, spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker process keeps from one task to the next, by name.
_KEPT: dict = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What make() gives, made once in a worker process, until an operator that doesn't use it runs there."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def slices(batches: Iterator[pa.RecordBatch], column: str = "_t", limit: int = SLICE_BYTES, keep: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches with at most `limit` bytes of text (one row at least), and their texts as UTF-8.

    Worker processes outlive an operator: what another one keeps there (all but `keep`) is let go.
    """
    if keep not in _KEPT:
        _KEPT.clear()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        lengths = pc.binary_length(texts).to_pylist()
        at = size = 0
        for i, n in enumerate(lengths):
            if i > at and size + n > limit:
                yield batch.slice(at, i - at), texts.slice(at, i - at).to_pylist()
                at, size = i, 0
            size += n
        if at < len(lengths):
            yield batch.slice(at), texts.slice(at).to_pylist()


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs with these lengths, the end included."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out

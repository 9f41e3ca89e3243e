"""Streams: progress of jobs, latest state with a time to live, uploads, cases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

# Percent and phase of each stage
PHASES = {"parse": (20, "extracting"), "extract": (40, "validating"), "validate": (50, "calculating"), "ratios": (55, "assessing"), "assess_5c": (80, "summarising"), "summarise": (95, "saving")}


def progress(events: DataFrame) -> DataFrame:
    """Stage events (job_id, stage) with the percent and phase that they stand for."""
    table = F.create_map(*[x for stage, (percent, phase) in PHASES.items() for x in (F.lit(stage), F.struct(F.lit(percent).alias("percent"), F.lit(phase).alias("phase")))])
    return events.withColumn("_p", table[F.col("stage")]).select(*events.columns, "_p.percent", "_p.phase")


def latest_state(events: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key, as an aggregation that a stream keeps up to date."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), at).alias("_r")).select(key, "_r.*")


class _Latest(StatefulProcessor):
    """Keeps the newest row of a key, and a timer that clears it when nothing comes for long enough."""

    def __init__(self, schema: StructType, key: str, keep: timedelta):
        self.names, self.key, self.keep = [n for n in schema.names if n != "_ms"], key, int(keep.total_seconds() * 1000)
        self.rest = StructType([f for f in schema if f.name != key])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("latest", self.rest)

    def _row(self, key: object, values: tuple, live: bool) -> Row:
        by_name = dict(zip(self.rest.names, values, strict=True)) | {self.key: key}
        return Row(**{n: by_name[n] for n in self.names}, live=live)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        at = self.rest.names.index("_ms")
        old = tuple(self.state.get()) if self.state.exists() else None
        new = max((tuple(r[n] for n in self.rest.names) for r in rows if r["_ms"] is not None), key=lambda r: r[at], default=None)
        if new is None or (old and new[at] < old[at]):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(new)
        self.handle.registerTimer(new[at] + self.keep)
        yield self._row(key[0], new, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        if self.state.exists():
            values = tuple(self.state.get())
            self.state.clear()
            yield self._row(key[0], values, False)

    def close(self) -> None:
        pass


def live_state(events: DataFrame, key: str, at: str, keep: timedelta = timedelta(days=7), late: str = "1 hour") -> DataFrame:
    """The newest row of each key with `live`; a stream in update mode gives a row whenever it changes.

    A key without events for as long as `keep` (an hour at least) leaves the state: a row with live
    false says so, and later events start it anew. Time is that of the events, which may come `late`;
    rows without a time are left out. The state store must be RocksDB's.
    """
    if keep < timedelta(hours=1):
        raise ValueError("states are kept for an hour at least")
    schema = StructType([*events.schema, StructField("live", BooleanType())])
    timed = events.withColumn("_ms", F.unix_millis(at))
    return timed.withWatermark(at, late).groupBy(key).transformWithState(_Latest(timed.schema, key, keep), schema, "Update", "EventTime")


def first_uploads(uploads: DataFrame, at: str = "ts", within: str = "7 days") -> DataFrame:
    """Uploads without those whose digest the application sent before, within the watermark."""
    return uploads.withWatermark(at, within).dropDuplicatesWithinWatermark(["application_id", "sha256"])


def case_status(events: DataFrame) -> DataFrame:
    """The newest status of each case and the number of its events."""
    return events.groupBy("case_id").agg(F.max_by("status", "at").alias("status"), F.count("*").alias("events"))


def into(store: Callable[[DataFrame, int], None], key: str, at: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the newest row of each key in the batch, given to any store (a callable of rows and epoch)."""
    return lambda batch, epoch: store(latest_state(batch, key, at).select(batch.columns), epoch)


def upsert(path: str, key: str, at: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table of the newest row per key, one version a batch.

    Each batch writes version `epoch` from the one before it, so a batch that runs again writes the same.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch if epoch == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/version={epoch - 1}"))
        latest_state(rows, key, at).select(batch.columns).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return write


def new_documents(batch_operator: Callable[[DataFrame], tuple[DataFrame, DataFrame]], good: str, rejects: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch operator's rows and rejects, each to its own folder; a failed document doesn't stop the rest."""

    def write(batch: DataFrame, epoch: int) -> None:
        kept, rejected = batch_operator(batch)
        kept.write.mode("overwrite").parquet(f"{good}/epoch={epoch}")
        rejected.write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")

    return write

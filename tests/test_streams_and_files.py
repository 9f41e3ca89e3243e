"""Streams against batches, and files."""

import json
from datetime import datetime, timedelta

from packaudit.sources import files
from packaudit.streaming import jobs

SCHEMA = "job_id string, stage string, ts timestamp"


def events(spark, folder):
    at = datetime(2025, 1, 1)
    rows = [(f"j{i % 3}", s, at + timedelta(minutes=10 * i + k)) for i in range(6) for k, s in enumerate(["parse", "extract"][: 1 + i % 2])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def drained(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(df.sparkSession.table(name).collect())


def test_latest_state_in_a_stream(spark, tmp_path):
    batch = events(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    want = sorted(jobs.latest_state(jobs.progress(batch), "job_id", "ts").collect())
    assert drained(jobs.latest_state(jobs.progress(stream), "job_id", "ts"), "complete", "latest") == want
    assert {r["phase"] for r in want} <= {p for _, p in jobs.PHASES.values()}


def test_upsert_by_batches(spark, tmp_path):
    batch = events(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(jobs.upsert(f"{tmp_path}/out", "job_id", "ts")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    got = sorted(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out/version={last}").collect())
    assert got == sorted(jobs.latest_state(batch, "job_id", "ts").select(batch.columns).collect())


def test_first_uploads_and_cases(spark, tmp_path):
    schema = "application_id string, sha256 string, ts timestamp"
    at = datetime(2025, 1, 1)
    spark.createDataFrame([("a", "x", at), ("a", "x", at), ("a", "y", at), ("b", "x", at)], schema).write.parquet(f"{tmp_path}/up")
    got = drained(jobs.first_uploads(spark.readStream.schema(schema).parquet(f"{tmp_path}/up")), "append", "uploads")
    assert [(r["application_id"], r["sha256"]) for r in got] == [("a", "x"), ("a", "y"), ("b", "x")]
    case = "case_id string, status string, at timestamp"
    rows = spark.createDataFrame([("c", "open", at), ("c", "closed", at + timedelta(hours=1))], case)
    assert jobs.case_status(rows).first()["status"] == "closed"


def test_new_documents(spark, tmp_path):
    schema = "document_id string, text string"
    spark.createDataFrame([("1", "ok"), ("2", None)], schema).write.parquet(f"{tmp_path}/docs")
    write = jobs.new_documents(lambda b: (b.where("text is not null"), b.where("text is null")), f"{tmp_path}/good", f"{tmp_path}/bad")
    q = spark.readStream.schema(schema).parquet(f"{tmp_path}/docs").writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == spark.read.parquet(f"{tmp_path}/bad").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "pack").mkdir()
    (tmp_path / "pack" / "a.pdf").write_bytes(b"abc")
    got = files.scan(spark, f"{tmp_path}/pack").first()
    assert got["base_id"] == "pack/a" and got["size"] == 3
    assert got["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    (tmp_path / "history").mkdir()
    for i in (1, 2):
        (tmp_path / "history" / f"{i}.json").write_text(json.dumps({"id": str(i), "created_at": f"2025-01-0{i}T00:00:00"}))
    assert [r["id"] for r in files.records(spark, f"{tmp_path}/history").collect()] == ["2", "1"]
    q = [f"I {w}" for w in "abcdefghij"]
    (tmp_path / "s.csv").write_text("﻿When," + ",".join(q) + "\nx," + ",".join("4" * 10) + "\n\n")
    assert files.survey(spark, f"{tmp_path}/s.csv", ["no"]).first()["answers"] == [4] * 10


def test_chunk_tables(spark, tmp_path):
    schema = "chunk_id string, document_id string, application_id string, text string"
    old = spark.createDataFrame([("1", "d", "a", "old"), ("2", "e", "b", "stays")], schema)
    new = spark.createDataFrame([("1", "d", "a", "new"), ("3", "d", "a", "more")], schema)
    now = files.upserted(old, new)
    assert sorted((r["chunk_id"], r["text"]) for r in now.collect()) == [("1", "new"), ("2", "stays"), ("3", "more")]
    assert [r["chunk_id"] for r in files.without_documents(now, new).collect()] == ["2"]
    files.write_chunks(old, f"{tmp_path}/c")
    files.write_chunks(new, f"{tmp_path}/c")
    assert sorted(r["chunk_id"] for r in spark.read.parquet(f"{tmp_path}/c").collect()) == ["1", "2", "3"]


def test_a_key_expires_and_comes_back(spark, tmp_path):
    schema = "job_id string, status string, ts timestamp"
    at = datetime(2025, 1, 1)
    steps = [
        [("a", "queued", at), ("a", "running", at + timedelta(hours=1)), ("b", "queued", at), (None, "queued", None)],
        [("a", "stale", at + timedelta(minutes=30)), ("b", "done", at + timedelta(days=5))],
        [("c", "queued", at + timedelta(days=9))],  # moves the watermark past a's seven days
        [("c", "running", at + timedelta(days=10))],
        [("a", "again", at + timedelta(days=10))],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = {}
        for i, rows in enumerate(steps):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/step{i}")

            def store(batch, epoch):
                for r in batch.orderBy("ts").collect():
                    seen.setdefault(i, []).append((r["job_id"], r["status"], r["live"]))  # noqa: B023

            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            q = jobs.live_state(stream, "job_id", "ts").writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert seen[0] == [("b", "queued", True), ("a", "running", True)]
    assert [r for r in seen[1] if r[0] == "a"] == [] and ("b", "done", True) in seen[1]
    later = [r for i in (2, 3) for r in seen.get(i, []) if r[0] == "a"]
    assert later == [("a", "running", False)]
    assert [r for r in seen[4] if r[0] == "a"] == [("a", "again", True)]


def test_a_pluggable_store(spark, tmp_path):
    kept = []
    write = jobs.into(lambda rows, epoch: kept.append((epoch, rows.count())), "job_id", "ts")
    write(events(spark, f"{tmp_path}/in"), 3)
    assert kept == [(3, 3)]

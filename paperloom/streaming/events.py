"""Structured Streaming over event tables: audit tails, sync ingestion, idempotency, leases, status machines, windows.

Each operator has a batch twin among the operators; on the same events they agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators.governance import fan_out
from paperloom.streaming.ordered import ROCKSDB, FirstEvidence, bucket_of


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 64) -> DataFrame:
    """New files of a folder of Parquet event files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tail_audit(events: DataFrame, after: int | None = None) -> DataFrame:
    """Audit events (event_id, tenant, event_type, ts) beyond a sequence, without document text; the checkpoint of the stream remembers where a reader is."""
    rows = events if after is None else events.filter(F.col("event_id") > after)
    return rows.select(F.col("event_id").alias("sequence"), "tenant", F.col("event_type").alias("action"), F.col("ts").alias("created_at"))


def audit_fanout(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A stream of audit events (event_id, action) by subscription: a stream-static join on the action and on ``*``."""
    return fan_out(events, subscriptions)


def event_windows(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, event_type and counts of each tumbling window; events later than the watermark no longer count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start and counts of each session."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def validate_sync(events: DataFrame) -> DataFrame:
    """Sync events (event_type, evidence, evidence_hash, overlay_hash, previews: an array of media_type, size and approved) with a verdict, ok where all rules hold."""
    good_preview = lambda p: p["approved"] & (p["media_type"] == "image/png") & (p["size"] <= 4 * 1024 * 1024)
    verdict = (
        F.when(F.col("event_type") != "archive.upsert", "event_type").when(F.sha2("evidence", 256) != F.col("evidence_hash"), "evidence_hash")
        .when(F.col("overlay_hash").isNotNull() & (F.col("overlay_hash") != F.col("evidence_hash")), "overlay_hash").when(F.size("previews") > 5, "too_many_previews").when(~F.forall("previews", good_preview), "preview").otherwise("ok")
    )
    return events.withColumn("verdict", verdict)


def ingest_sync(events: DataFrame, target: str, checkpoint: str):
    """Starts a stream that appends each batch's new evidence (by hash, once) and its rejected events to Parquet tables below ``target``; safe to run again.

    Which hashes have been there is state in RocksDB, so a batch reads nothing of
    what is stored. Evidence is partitioned by batch and a batch that is repeated
    overwrites its own partition, so a retry adds nothing twice.
    """
    identity = F.to_json(F.struct("resource_id", "evidence_hash"), {"ignoreNullFields": "false"})
    judged = validate_sync(events).select(*FirstEvidence.columns, identity.alias("identity"))
    kinds = ", ".join(f"{c} {judged.schema[c].dataType.simpleString()}" for c in FirstEvidence.columns)
    fresh = judged.withColumn("bucket", bucket_of("identity")).groupBy("bucket").transformWithStateInPandas(statefulProcessor=FirstEvidence(), outputStructType=kinds, outputMode="Append", timeMode="None")

    def store(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        batch.filter("verdict = 'ok'").select("resource_id", "evidence_hash", "evidence", "occurred_at").write.mode("overwrite").parquet(f"{target}/evidence/epoch={epoch}")
        batch.filter("verdict <> 'ok'").select("event_id", "verdict").write.mode("overwrite").parquet(f"{target}/rejected/epoch={epoch}")
        batch.unpersist()

    with _state_in(events.sparkSession, ROCKSDB):
        return fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def _state_in(spark: SparkSession, provider: str | None):
    """Streams that start meanwhile keep their state there; the setting is put back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    if provider:
        spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> list:
    """The key's rows of a micro-batch in order."""
    return list(pd.concat(list(batches)).sort_values(list(order)).itertuples())


def _remembering(events: DataFrame, key: str, schema: str, kept_ms: int, judge: Callable[[tuple, str | None], tuple[tuple | None, str]]) -> DataFrame:
    """The rows that ``judge`` makes of each event and what is remembered of its key (a text, None at first), in order within a micro-batch.

    One call does a group of keys (``bucket_of``), whose state is a row of arrays.
    A key without an event for ``kept_ms`` is forgotten.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def follow(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nothing came for any of its keys
            state.remove()
            return
        now, out = state.getCurrentProcessingTimeMs(), []
        known = {k: (held, at) for k, held, at in zip(*state.get, strict=True) if now - at < kept_ms} if state.exists else {}
        for r in _rows(batches, "ts", "event_id"):
            row, held = judge(r, known[r.key][0] if r.key in known else None)
            known[r.key] = (held, now)
            if row is not None:
                out.append(row)
        state.update(tuple(map(list, zip(*((k, held, at) for k, (held, at) in known.items()), strict=True))))
        state.setTimeoutDuration(kept_ms)
        yield pd.DataFrame(out, columns=names)

    keyed = events.withColumn("key", F.col(key).cast("string")).withColumn("bucket", bucket_of("key"))
    return keyed.groupBy("bucket").applyInPandasWithState(follow, schema, "key array<string>, held array<string>, at array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def idempotent_stream(events: DataFrame, kept_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """key, event_id and outcome (new, replay, conflict) of events (key, event_id, request_hash, ts). After seven days without a request a key counts as new."""

    def judge(r: tuple, first: str | None) -> tuple[tuple, str]:
        outcome = "new" if first is None else "replay" if first == r.request_hash else "conflict"
        return (r.key, int(r.event_id), outcome), r.request_hash if first is None else first

    return _remembering(events, "key", "key string, event_id long, outcome string", kept_ms, judge)


def expired_leases_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """job_id and status queued of jobs (job_id, status, ts, lease_until in milliseconds) whose lease ends, in event time, before another event renews or ends it."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": ["queued"]})
            return
        last = _rows(batches, "ts")[-1]
        if last.status != "claimed":
            if state.exists:
                state.remove()
        elif int(last.lease_until) <= state.getCurrentWatermarkMs():
            yield pd.DataFrame({"job_id": [key[0]], "status": ["queued"]})
        else:
            state.update((int(last.lease_until),))
            state.setTimeoutTimestamp(int(last.lease_until))

    timed = events.withWatermark("ts", late)
    return timed.groupBy("job_id").applyInPandasWithState(watch, "job_id string, status string", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def status_timeline(events: DataFrame, allowed: set[tuple[str, str]], kept_ms: int = 90 * 24 * 3600 * 1000) -> DataFrame:
    """Forbidden status changes of a stream of events (resource_id, event_id, status, ts), in order within each batch. A resource without an event for ``kept_ms`` is forgotten: its next status counts as the first."""

    def judge(r: tuple, last: str | None) -> tuple[tuple | None, str]:
        wrong = last is not None and last != r.status and (last, r.status) not in allowed
        return ((r.key, int(r.event_id), last, r.status) if wrong else None), r.status

    return _remembering(events, "resource_id", "resource_id string, event_id long, from_status string, to_status string", kept_ms, judge)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append", close: bool = False, state: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now into a Parquet table, and reads that table. With ``close`` a last batch without data brings out what the watermark has passed; ``state`` names the provider of its state."""
    conf, key = df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, str(close).lower())  # a processing-time timeout asks for one more batch for ever
    try:
        with _state_in(df.sparkSession, state):
            query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Streams in event time: events late, repeated and out of order, over three micro-batches with a restart after each, equal their batch twins."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.operators import governance, jobs
from paperloom.streaming import events as stream
from paperloom.streaming import ordered

START = datetime(2024, 1, 1)
SCHEMA = "key string, event_id long, request_hash string, status string, ts timestamp, lease_until long"


def parts(seed: int):
    """Three batches of events: each comes in any order, and some come a batch later than they should; a last event of another key moves the watermark past all."""
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        at = START + timedelta(minutes=rng.randint(0, 3 * 240), seconds=rng.randint(0, 59), milliseconds=rng.randint(0, 999))
        lease = int((at - datetime(1970, 1, 1)).total_seconds() + rng.choice([60, 1800, 9000])) * 1000
        rows.append((f"k{rng.randint(0, 11)}", i, rng.choice("ab"), rng.choice(["open", "in_review", "approved", "claimed", "claimed"]), at, lease))
    rows += [(rows[0][0], 1000, "a", "open", rows[0][4], rows[0][5])]  # a tie in time
    out = [[], [], []]
    for r in rows:
        own = min(2, int((r[4] - START).total_seconds()) // (240 * 60))
        out[min(2, own + (rng.random() < 0.2))].append(r)
    for part in out:
        rng.shuffle(part)
    return rows, out, ("end", 9999, "a", "open", START + timedelta(days=400), 0)


def streamed(spark, tmp_path, batches, make, end):
    """The stream's rows after a run for each batch, each from the checkpoint of the one before."""
    source, out = f"{tmp_path}/events", None
    for batch in [*batches, [end]]:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = stream.run_once(make(stream.event_stream(spark, source, spark.createDataFrame([], SCHEMA).schema)), f"{tmp_path}/out", f"{tmp_path}/state", close=True, state=ordered.ROCKSDB)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_idempotency(spark, tmp_path, seed):
    rows, batches, end = parts(seed)
    found = streamed(spark, tmp_path, batches, lambda e: ordered.idempotent_in_order(e, "1 day", None), end).filter("key <> 'end'")
    twin = jobs.idempotent(spark.createDataFrame(rows, SCHEMA).withColumns({"tenant": F.lit("t"), "endpoint": F.lit("e")}))
    pick = lambda df: sorted(tuple(r) for r in df.select("key", "event_id", "outcome").collect())
    assert pick(found) == pick(twin) and len({r[2] for r in pick(found)}) == 3


def test_status(spark, tmp_path):
    rows, batches, end = parts(3)
    allowed = {(a, b) for a, to in governance.TRANSITIONS["review_task"].items() for b in to}
    found = streamed(spark, tmp_path, batches, lambda e: ordered.status_in_order(e.withColumnRenamed("key", "resource_id"), allowed, "1 day", None), end)
    expected, last = [], {}
    for key, event_id, _, status, *_ in sorted(rows, key=lambda r: (r[4], r[1])):
        before = last.get(key)
        if before is not None and before != status and (before, status) not in allowed:
            expected.append((key, event_id, before, status))
        last[key] = status
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected) and expected


def test_leases(spark, tmp_path):
    rows, batches, end = parts(4)
    found = streamed(spark, tmp_path, batches, lambda e: ordered.leases_in_order(e.withColumnRenamed("key", "job_id"), "1 day"), end)
    by_key: dict = {}
    for r in sorted(rows, key=lambda r: (r[4], r[1])):
        by_key.setdefault(r[0], []).append(r)
    expected = []
    for key, own in by_key.items():
        for r, following in zip(own, [*own[1:], None], strict=True):
            until = datetime(1970, 1, 1) + timedelta(milliseconds=r[5])
            if r[3] == "claimed" and (following is None or following[4] > until):
                expected.append((key, "queued", r[5]))
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected) and expected


def test_what_is_forgotten_counts_as_new(spark, tmp_path):
    event = lambda i, hours: ("k", i, "a", "approved" if i % 2 else "open", START + timedelta(hours=hours), 0)
    batches, end = [[event(0, 0), event(1, 1)], [event(2, 40)], [event(3, 41), event(4, 200)]], ("end", 9, "a", "open", START + timedelta(days=400), 0)
    day = 24 * 3600 * 1000
    found = streamed(spark, tmp_path, batches, lambda e: ordered.idempotent_in_order(e, "1 hour", day), end).filter("key = 'k'")
    assert {r["event_id"]: r["outcome"] for r in found.collect()} == {0: "new", 1: "replay", 2: "new", 3: "replay", 4: "new"}


def test_evidence_is_stored_once_over_batches(spark, tmp_path):
    none = F.array().cast("array<struct<media_type:string,size:int,approved:boolean>>")

    def events(source):
        own = F.sha2("request_hash", 256)
        return source.select(
            "event_id", F.lit("archive.upsert").alias("event_type"), "key", F.col("key").alias("resource_id"), F.col("request_hash").alias("evidence"), F.when(F.col("event_id") % 9 == 0, "wrong").otherwise(own).alias("evidence_hash"),
            F.lit(None).cast("string").alias("overlay_hash"), none.alias("previews"), F.col("ts").alias("occurred_at"),
        )

    rows, batches, _ = parts(5)
    source = f"{tmp_path}/events"
    for batch in [*batches, batches[0]]:  # the first comes again
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream.ingest_sync(events(stream.event_stream(spark, source, spark.createDataFrame([], SCHEMA).schema)), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    stored = [(r["resource_id"], r["evidence"]) for r in spark.read.parquet(f"{tmp_path}/out/evidence").collect()]
    assert sorted(stored) == sorted({(r[0], r[2]) for r in rows if r[1] % 9})
    assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == sum(r[1] % 9 == 0 for r in rows) + sum(r[1] % 9 == 0 for r in batches[0])


def many(n: int = 600):
    """Two batches of events of so many keys that keys share their group."""
    event = lambda i, hours, h: (f"k{i}", i * 10 + hours, h, "open" if hours else "approved", START + timedelta(hours=hours), int((START - datetime(1970, 1, 1)).total_seconds() + 3600) * 1000)
    first = [event(i, h, "a" if i % 3 else "ab"[h]) for i in range(n) for h in (0, 1)]
    return [first, [event(i, 2, "b") for i in range(0, n, 2)]], ("end", 9, "a", "open", START + timedelta(days=400), 0)


def grouped(df) -> str:
    """What the calls of a stateful operator are made for."""
    return re.search(r"(?:TransformWithState|FlatMapGroupsInPandasWithState)\w* .*", df._jdf.queryExecution().analyzed().toString()).group(0)


def test_requests_of_many_keys_are_judged_by_groups(spark, tmp_path):
    batches, _ = many()
    rows = batches[0] + batches[1]
    source = f"{tmp_path}/events"
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        made = stream.idempotent_stream(stream.event_stream(spark, source, spark.createDataFrame([], SCHEMA).schema))
        assert "bucket" in grouped(made)
        found = stream.run_once(made, f"{tmp_path}/out", f"{tmp_path}/state")
    twin = jobs.idempotent(spark.createDataFrame(rows, SCHEMA).withColumns({"tenant": F.lit("t"), "endpoint": F.lit("e")}))
    pick = lambda df: sorted(tuple(r) for r in df.select("key", "event_id", "outcome").collect())
    assert pick(found) == pick(twin) and len(rows) == 1500


def test_events_of_many_keys_are_judged_by_groups(spark, tmp_path):
    batches, end = many()
    rows = batches[0] + batches[1]
    made = []
    found = streamed(spark, tmp_path, batches, lambda e: made.append(ordered.idempotent_in_order(e, "1 hour", None)) or made[-1], end).filter("key <> 'end'")
    assert "bucket" in grouped(made[0])
    twin = jobs.idempotent(spark.createDataFrame(rows, SCHEMA).withColumns({"tenant": F.lit("t"), "endpoint": F.lit("e")}))
    pick = lambda df: sorted(tuple(r) for r in df.select("key", "event_id", "outcome").collect())
    assert pick(found) == pick(twin)


def test_statuses_and_leases_of_many_keys_are_judged_by_groups(spark, tmp_path):
    batches, end = many(300)
    batches = [[(k, i, h, "claimed" if s == "open" else s, at, until) for k, i, h, s, at, until in b] for b in batches]
    end = (*end[:3], "done", *end[4:])
    made = []
    found = streamed(spark, f"{tmp_path}/a", batches, lambda e: made.append(ordered.status_in_order(e.withColumnRenamed("key", "resource_id"), {("approved", "open")}, "1 hour", None)) or made[-1], end)
    assert sorted(r["event_id"] for r in found.collect()) == [i * 10 + 1 for i in range(300)]
    found = streamed(spark, f"{tmp_path}/b", batches, lambda e: made.append(ordered.leases_in_order(e.withColumnRenamed("key", "job_id"), "1 hour")) or made[-1], end)
    # a lease until 1:00 that began at 1:00 has ended when another event comes at 2:00, or when the watermark has passed it
    assert sorted(r["job_id"] for r in found.collect()) == sorted([f"k{i}" for i in range(300)] + [f"k{i}" for i in range(0, 300, 2)])
    assert all("bucket" in grouped(df) for df in made)


def test_evidence_of_many_resources_is_stored_once_by_groups(spark, tmp_path):
    none = F.array().cast("array<struct<media_type:string,size:int,approved:boolean>>")
    batches, _ = many(300)
    source, own = f"{tmp_path}/events", F.sha2("request_hash", 256)
    for batch in [*batches, batches[0]]:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        e = stream.event_stream(spark, source, spark.createDataFrame([], SCHEMA).schema)
        sync = e.select("event_id", F.lit("archive.upsert").alias("event_type"), F.col("key").alias("resource_id"), F.col("request_hash").alias("evidence"), own.alias("evidence_hash"), F.lit(None).cast("string").alias("overlay_hash"), none.alias("previews"), F.col("ts").alias("occurred_at"))
        query = stream.ingest_sync(sync, f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
    assert "bucket" in query._jsq.explainInternal(True)
    stored = [(r["resource_id"], r["evidence"], r["occurred_at"]) for r in spark.read.parquet(f"{tmp_path}/out/evidence").collect()]
    expected = {}
    for key, _, h, _, at, _ in batches[0] + batches[1]:
        expected[key, h] = min(at, expected.get((key, h), at))
    assert sorted(stored) == sorted((*k, at) for k, at in expected.items())

"""Streams that judge each key's events in event time, however late and in whatever order they come.

An event waits in the state until the watermark has passed it; then it is
judged after all that came before it. Keys are dealt to groups by their hash. A
group has one timer, for what happens to its keys next: the earliest waiting
event, the end of a lease, or the time after which a key is forgotten. State is typed, lives in RocksDB and is restored from the
checkpoint. Events later than the watermark are dropped by Spark, as stated by
``late``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where the state of these streams lives: ``events.run_once(..., state=ROCKSDB)``, or set it in the session before a stream starts.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DAY_MS = 24 * 3600 * 1000


#: Groups that keys are dealt to by their hash. A call, its state and its timer are a group's, so that millions of keys are not as many calls. A checkpoint holds for the number that it was made with.
BUCKETS = 4096


def bucket_of(*keys: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _values(column: pd.Series, kind: str) -> list:
    """A column's values as the state takes them: pandas holds whole numbers with nulls among them as floats."""
    if kind == "bigint" and column.dtype.kind != "i":
        return [None if pd.isna(v) else int(v) for v in column]
    return column.tolist()


def _arrays(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} array<{t}>" for n, t in fields.items())


class InOrder(StatefulProcessor):
    """Hands each key's events to ``judge`` in the order of time and event_id, once the watermark has passed them.

    It is called for groups of keys (``bucket_of``), whose state is a row of
    arrays with an entry for each event that waits, and each key that is
    remembered. ``fields``: the columns of an event beside its key, time and id,
    ``held``: what is remembered of a key (its first field the time of the last
    event in microseconds). ``kept_ms``: how long after its last event a key is
    remembered, None: for good.
    """

    fields: dict[str, str] = {}
    held: dict[str, str] = {}
    columns: list[str] = []

    def __init__(self, kept_ms: int | None = None) -> None:
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = {"key": "string", "us": "bigint", "event_id": "bigint", **self.fields}
        self.waiting = handle.getValueState("waiting", _arrays(self.event))
        self.last = handle.getValueState("last", _arrays({"key": "string", "us": "bigint", **self.held}))

    def judge(self, key: tuple, event: tuple, last: tuple | None) -> tuple[list[tuple], tuple]:
        """The rows that an event brings, and what is remembered after it."""
        raise NotImplementedError

    def ended(self, key: tuple, last: tuple, watermark: int) -> tuple[list[tuple], bool]:
        """Rows that the watermark alone brings, and whether the key's memory is over."""
        return [], False

    def until(self, last: tuple) -> int | None:
        """When something ends without an event, in milliseconds."""
        return None

    def _next(self, last: tuple) -> list[int]:
        """When a key's memory has to be looked at without an event, in milliseconds."""
        kept = [] if self.kept_ms is None else [last[0] // 1000 + self.kept_ms]
        return kept + [t for t in (self.until(last),) if t is not None]

    def _settle(self, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        stored = list(zip(*self.waiting.get(), strict=True)) if self.waiting.exists() else []
        known = {k: tuple(held) for k, *held in zip(*self.last.get(), strict=True)} if self.last.exists() else {}
        before = dict(known)
        due, rest = [], []
        for event in (*stored, *new):
            (due if event[1] <= watermark * 1000 else rest).append(event)
        for key, *event in sorted(due, key=lambda e: e[1:3]):
            rows, known[key] = self.judge((key,), tuple(event), known.get(key))
            out += rows
        still = {e[0] for e in rest}
        for key, last in list(known.items()):
            more, over = self.ended((key,), last, watermark)
            out += more
            if over or (self.kept_ms is not None and key not in still and last[0] // 1000 + self.kept_ms <= watermark):
                del known[key]
        if known != before:
            self.last.update(tuple(map(list, zip(*((k, *held) for k, held in known.items()), strict=True)))) if known else self.last.clear()
        if rest and (new or due):
            self.waiting.update(tuple(map(list, zip(*rest, strict=True))))
        elif stored and not rest:
            self.waiting.clear()
        following = [-(-e[1] // 1000) for e in rest] + [t for last in known.values() for t in self._next(last)]
        timer = [max(min(following), watermark + 1)] if following else []
        held = list(self.handle.listTimers())
        for t in held:
            if t not in timer:
                self.handle.deleteTimer(t)
        for t in timer:
            if t not in held:
                self.handle.registerTimer(t)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [e for batch in rows for e in zip(*(_values(batch[c], t) for c, t in self.event.items()), strict=True)]
        yield from self._settle(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle([], timerValues.getCurrentWatermarkInMs())


class Idempotent(InOrder):
    fields, held, columns = {"request_hash": "string"}, {"request_hash": "string"}, ["key", "event_id", "outcome"]

    def judge(self, key, event, last):
        us, event_id, request_hash = event
        if last is None or (self.kept_ms is not None and us - last[0] >= self.kept_ms * 1000):
            return [(key[0], event_id, "new")], (us, request_hash)
        return [(key[0], event_id, "replay" if request_hash == last[1] else "conflict")], (us, last[1])


class Status(InOrder):
    fields, held, columns = {"status": "string"}, {"status": "string"}, ["resource_id", "event_id", "from_status", "to_status"]

    def __init__(self, allowed: set[tuple[str, str]], kept_ms: int | None = None) -> None:
        super().__init__(kept_ms)
        self.allowed = allowed

    def judge(self, key, event, last):
        us, event_id, status = event
        known = last is not None and not (self.kept_ms is not None and us - last[0] >= self.kept_ms * 1000)
        wrong = known and last[1] != status and (last[1], status) not in self.allowed
        return [(key[0], event_id, last[1], status)] if wrong else [], (us, status)


class Lease(InOrder):
    fields, held, columns = {"status": "string", "lease_until": "bigint"}, {"status": "string", "lease_until": "bigint"}, ["job_id", "status", "lease_until"]

    def judge(self, key, event, last):
        us, _, status, lease_until = event
        expired = last is not None and last[1] == "claimed" and last[2] * 1000 < us
        return [(key[0], "queued", last[2])] if expired else [], (us, status, lease_until)

    def ended(self, key, last, watermark):
        if last[1] != "claimed":
            return [], True
        return ([(key[0], "queued", last[2])], True) if last[2] <= watermark else ([], False)

    def until(self, last):
        return last[2]


def _in_order(events: DataFrame, key: str, processor: InOrder, schema: str, late: str) -> DataFrame:
    timed = events.withWatermark("ts", late).select("ts", F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), *processor.fields)
    return timed.withColumn("bucket", bucket_of("key")).groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def idempotent_in_order(events: DataFrame, late: str = "1 day", kept_ms: int | None = 7 * DAY_MS) -> DataFrame:
    """key, event_id and outcome (new, replay, conflict) of events (key, event_id, request_hash, ts). ``kept_ms`` after its last request a key counts as new."""
    return _in_order(events, "key", Idempotent(kept_ms), "key string, event_id long, outcome string", late)


def status_in_order(events: DataFrame, allowed: set[tuple[str, str]], late: str = "1 day", kept_ms: int | None = 90 * DAY_MS) -> DataFrame:
    """Forbidden status changes of events (resource_id, event_id, status, ts). ``kept_ms`` after its last event a resource is forgotten: its next status counts as the first."""
    return _in_order(events, "resource_id", Status(allowed, kept_ms), "resource_id string, event_id long, from_status string, to_status string", late)


def leases_in_order(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """job_id, status queued and lease_until of each lease of events (job_id, event_id, status, ts, lease_until in milliseconds) that ends before another event of its job renews or ends it."""
    return _in_order(events, "job_id", Lease(), "job_id string, status string, lease_until long", late)


class FirstEvidence(StatefulProcessor):
    """The first row of each resource and evidence hash (``identity``) that is in order, and all rows that are not; called for groups of identities."""

    columns = ["resource_id", "evidence_hash", "evidence", "occurred_at", "event_id", "verdict"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "identity array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, best = set(self.seen.get()[0]) if self.seen.exists() else set(), None
        for batch in rows:
            fine = batch["verdict"] == "ok"
            if not fine.all():
                yield batch.loc[~fine, self.columns]
            good = batch[fine & ~batch["identity"].isin(known)]
            if len(good):
                best = (good if best is None else pd.concat([best, good])).sort_values(["occurred_at", "event_id"]).drop_duplicates("identity")
        if best is not None:
            self.seen.update(([*known, *best["identity"]],))
            yield best[self.columns]

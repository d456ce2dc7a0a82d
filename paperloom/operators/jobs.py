"""Job history: filters, pages, lifecycles, retries and leases. ``now`` is always a parameter."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.keys import backoff_seconds


def seconds_later(time: Column | str, seconds: Column) -> Column:
    """A time so many seconds later, of the type that it has."""
    return (F.col(time) if isinstance(time, str) else time) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def filter_jobs(jobs: DataFrame, query: str | None = None, workflow: str | None = None, status: str | None = None, created_from: datetime | None = None, created_to: datetime | None = None, pinned: bool | None = None) -> DataFrame:
    """Jobs that meet all conditions given; a name holds the query in any case."""
    if created_from and created_to and created_to < created_from:
        raise ValueError("the range ends before it begins")
    if query:
        jobs = jobs.filter(F.contains(F.lower("input_name"), F.lit(query.lower())))
    for column, value in (("workflow", workflow), ("status", status), ("pinned", pinned)):
        if value is not None:
            jobs = jobs.filter(F.col(column) == value)
    if created_from is not None:
        jobs = jobs.filter(F.col("created_at") >= F.lit(created_from))
    if created_to is not None:
        jobs = jobs.filter(F.col("created_at") <= F.lit(created_to))
    return jobs


def job_summary(jobs: DataFrame) -> DataFrame:
    """Jobs with duration_ms and whether a result and an analysis can be read."""
    took = F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return jobs.withColumn("duration_ms", F.when(took > 0, took).when(took.isNotNull(), 0)).withColumn("result_available", F.col("status") == "completed").withColumn("analysis_available", F.coalesce(F.col("analysis_status") == "ready", F.lit(False)) if "analysis_status" in jobs.columns else F.lit(False))


SORTS = {"newest": [F.desc, "created_at"], "oldest": [F.asc, "created_at"], "name": [F.asc, "input_name"], "quality": [F.desc, "quality_score"]}


def job_list(jobs: DataFrame, sort: str = "newest", limit: int = 50, offset: int = 0, key: str = "job_id") -> DataFrame:
    """A page of jobs, pinned ones first, in one of four orders."""
    way, column = SORTS[sort]
    return jobs.orderBy(F.desc("pinned"), way(column), key).offset(offset).limit(limit)


def job_total(jobs: DataFrame) -> DataFrame:
    """One row: how many jobs the list holds, and how many of them are pinned."""
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.coalesce("pinned", F.lit(False))).alias("pinned"))


def encode_cursor(at: datetime, identifier: object) -> str:
    """A page's end (time and id of its last row) as one opaque word that is safe in an address."""
    return base64.urlsafe_b64encode(json.dumps([at.isoformat(), identifier]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[datetime, object]:
    """The time and id in a cursor; ValueError where it is none, whatever is wrong with it."""
    try:
        at, identifier = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), b"-_", validate=True))
        if isinstance(identifier, bool) or not isinstance(identifier, (str, int)):
            raise TypeError("an id is a text or a number")
        return datetime.fromisoformat(at), identifier
    except (ValueError, TypeError) as e:
        raise ValueError(f"not a cursor: {cursor!r}") from e


def keyset_page(rows: DataFrame, limit: int, after: tuple | str | None = None, order: tuple[str, str] = ("updated_at", "id")) -> DataFrame:
    """A page newest first and one row more, which says whether there is a next page; ``after`` is the last row of the page before, or its cursor.

    Rows without a time are on no page.
    """
    time, key = order
    rows = rows.filter(F.col(time).isNotNull())
    if after is not None:
        end = decode_cursor(after) if isinstance(after, str) else after
        at, identifier = F.lit(end[0]), F.lit(end[1])
        rows = rows.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < identifier)))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit + 1)


def cursor_page(rows: DataFrame, limit: int, cursor: str | None = None, order: tuple[str, str] = ("updated_at", "id")) -> tuple[list, str | None]:
    """The rows of a page, and the cursor of the next one or none: what a client is answered. At most ``limit`` + 1 rows reach the driver.

    Going from cursor to cursor sees each row that stays as it is once, whatever
    is added in the meantime.
    """
    time, key = order
    found = keyset_page(rows, limit, cursor, order).collect()
    page = found[:limit]
    return page, encode_cursor(page[-1][time], page[-1][key]) if len(found) > limit and page else None


def filter_bank(items: DataFrame, status: str | None = None, query: str | None = None, limit: int = 100) -> DataFrame:
    """Bank items newest first; the query is looked for in the payload, a per cent sign is no wild card; limit from 1 to 500."""
    if status:
        items = items.filter(F.col("status") == status)
    if query:
        items = items.filter(F.contains(F.lower("payload"), F.lit(query.lower().replace("%", ""))))
    return items.orderBy(F.desc("updated_at"), "item_id").limit(max(1, min(500, limit)))


def filter_outbox(outbox: DataFrame, status: str | None = None, now: datetime | None = None) -> DataFrame:
    """Outbox events in order of time, of a status, and due at ``now``."""
    if status:
        outbox = outbox.filter(F.col("status") == status)
    if now is not None:
        outbox = outbox.filter(F.coalesce(F.col("next_attempt_at") <= F.lit(now), F.lit(True)))
    return outbox.orderBy("created_at", "event_id")


def filter_audit(events: DataFrame, newest: int | None = None, **equal: object) -> DataFrame:
    """Audit events with the values given, in order of time, or the newest so many."""
    for column, value in equal.items():
        events = events.filter(F.col(column) == value)
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(newest) if newest else events.orderBy("created_at", "event_id")


def idempotent(requests: DataFrame, keys: Sequence[str] = ("tenant", "endpoint", "key"), order: Sequence[str] = ("ts", "event_id"), request_hash: str = "request_hash") -> DataFrame:
    """Requests with their outcome: the first of a key is new, a later one with its hash a replay, with another a conflict."""
    line = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(request_hash).over(line)
    return requests.withColumn("outcome", F.when(F.row_number().over(line) == 1, "new").when(F.col(request_hash).eqNullSafe(first), "replay").otherwise("conflict"))


def dispatch_plan(deliveries: DataFrame, subscriptions: DataFrame, events: DataFrame, now: datetime, most: int = 10) -> DataFrame:
    """Due deliveries, oldest first, and what comes next: failed where the subscription, the event or further attempts are missing, else the time of the next try if this one fails."""
    due = deliveries.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= F.lit(now)))
    there = due.join(subscriptions.select("subscription_id", F.lit(True).alias("subscribed")).distinct(), "subscription_id", "left").join(events.select("event_id", F.lit(True).alias("known")).distinct(), "event_id", "left")
    tried = F.col("attempt") + 1
    lost = F.col("subscribed").isNull() | F.col("known").isNull()
    wait = backoff_seconds(tried)
    return there.withColumn("action", F.when(lost, "fail_missing_parent").when(tried > most, "fail_exhausted").otherwise("post")).withColumn("retry_at", F.when(~lost & (tried < most), seconds_later(F.lit(now), wait))).drop("subscribed", "known").orderBy("next_attempt_at", "delivery_id")


def delivery_outcomes(attempts: DataFrame, most: int = 10) -> DataFrame:
    """Attempts (delivery_id, attempt, ok, ts) with the state after each: delivered, pending until next_attempt_at, failed."""
    wait = backoff_seconds("attempt")
    state = F.when(F.col("ok"), "delivered").when(F.col("attempt") >= most, "failed").otherwise("pending")
    return attempts.withColumn("state", state).withColumn("next_attempt_at", F.when(state == "pending", seconds_later("ts", wait)))


def outbox_state(outcomes: DataFrame) -> DataFrame:
    """event key with attempts, state and next_attempt_at after its outcomes (key, ts, seq, ok): it never gives up."""
    last = outcomes.groupBy("key").agg(F.count("*").alias("attempts"), F.max_by(F.struct("ok", "ts"), F.struct("ts", "seq")).alias("last"))
    wait = backoff_seconds("attempts", 30, 7)
    return last.select("key", "attempts", F.when(F.col("last.ok"), "delivered").otherwise("pending").alias("state"), F.when(~F.col("last.ok"), seconds_later("last.ts", wait)).alias("next_attempt_at"))


def latest_state(events: DataFrame, key: str, *order: str) -> DataFrame:
    rows = events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("row"))
    return rows.select("row.*")


def expired_leases(latest: DataFrame, now: datetime) -> DataFrame:
    """Claimed jobs whose lease has ended, or that have none: to be queued again."""
    return latest.filter((F.col("status") == "claimed") & F.coalesce(F.col("lease_expires_at") <= F.lit(now), F.lit(True))).withColumn("status", F.lit("queued"))


def expired_sources(sources: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Staged sources older than so many hours that nothing has consumed."""
    return sources.filter((F.col("status") == "staged") & (seconds_later("created_at", F.lit(hours * 3600)) <= F.lit(now))).withColumn("status", F.lit("expired"))


def recover_interrupted(latest: DataFrame) -> DataFrame:
    """States after a restart: processing jobs have failed, processing items are queued to be tried again."""
    running = F.col("status") == "processing"
    return latest.withColumn("retry", running & (F.col("kind") == "item")).withColumn("status", F.when(running & (F.col("kind") == "job"), "failed").when(running, "queued").otherwise(F.col("status")))


def expire_terminal_jobs(jobs: DataFrame, cutoff: datetime, statuses: Sequence[str] = ("completed", "failed", "cancelled")) -> tuple[DataFrame, DataFrame]:
    """Jobs that stay, and those in a final state before the cutoff. Timestamps are compared, pinned jobs stay."""
    old: Column = F.col("status").isin(list(statuses)) & (F.col("updated_at") < F.lit(cutoff)) & ~F.coalesce("pinned", F.lit(False))
    return jobs.filter(~old), jobs.filter(old)


def batch_status(items: DataFrame) -> DataFrame:
    """batch_id and its status: completed if all items are, partial once none is queued or processing, else processing."""
    return items.groupBy("batch_id").agg(F.when(F.bool_and(F.col("status") == "completed"), "completed").when(~F.bool_or(F.col("status").isin("queued", "processing")), "partial").otherwise("processing").alias("status"), F.count("*").alias("n_items"))

"""Queries of the streams: the events as files, run once to their end, and held against the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import governance, reconcile
from paperloom.plans import views as V
from paperloom.plans.catalogue import ORACLES, QUERIES, STATUS, SUBSCRIPTIONS, _event_files, _scratch, query
from paperloom.streaming import events as stream
from paperloom.streaming import ordered


def _run(df, **options):
    at = _scratch(df.sparkSession)
    return stream.run_once(df, f"{at}/out", f"{at}/state", **options)


@query(ORACLES["fan_out"])
def fan_out_stream(spark, sf):
    subs = spark.sql("select * from values (1, array('view')), (2, array('click', 'error')), (3, array('*', 'view')) as t(subscription_id, event_types)")
    return _run(stream.audit_fanout(_event_files(spark, sf).select("event_id", F.col("event_type").alias("action")), subs))


@query(ORACLES["transition_violations"].replace("SELECT user_id, event_id, from_status", "SELECT user_id AS resource_id, event_id, from_status").replace("ORDER BY event_id)", "ORDER BY ts, event_id)").replace("AS to_status FROM events", "AS to_status, ts FROM events"))
def status_stream(spark, sf):
    allowed = {(a, b) for a, to in governance.TRANSITIONS["review_task"].items() for b in to}
    e = _event_files(spark, sf).select(F.col("user_id").cast("string").alias("resource_id"), "event_id", F.expr(STATUS).alias("status"), "ts")
    return _run(stream.status_timeline(e, allowed)).select(F.col("resource_id").cast("long").alias("resource_id"), "event_id", "from_status", "to_status")


@query(ORACLES["idempotent_replay"])
def idempotent_stream(spark, sf):
    k = F.get_json_object("props", "$.k")
    e = _event_files(spark, sf).select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", k).alias("key"), "event_id", F.sha2(F.floor("value").cast("string"), 256).alias("request_hash"), "ts")
    return _run(stream.idempotent_stream(e)).select("event_id", "key", "outcome")


@query("SELECT * FROM (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)")
def windows_stream(spark, sf):
    """Windows that the watermark has closed."""
    return _run(stream.event_windows(_event_files(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))), close=True).withColumn("total", F.round("total", 2))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type IN ('view', 'click') AS claimed, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events), w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 MINUTE AS at FROM events)
SELECT CAST(user_id AS VARCHAR) AS job_id, 'queued' AS status FROM e, w WHERE claimed AND later IS NULL AND date_trunc('second', ts) + INTERVAL 1 HOUR <= w.at""")
def lease_stream(spark, sf):
    """Leases that end, in event time, before the watermark."""
    until = (F.unix_seconds(F.col("ts").cast("timestamp")) + 3600) * 1000
    e = _event_files(spark, sf).select(F.col("user_id").cast("string").alias("job_id"), F.when(F.col("event_type").isin("view", "click"), "claimed").otherwise("done").alias("status"), F.col("ts").cast("timestamp").alias("ts"), until.alias("lease_until"))
    return _run(stream.expired_leases_stream(e), close=True)


PASSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)"


@query("SELECT event_id, key, outcome FROM (" + ORACLES["idempotent_replay"].replace("SELECT event_id, key, CASE", "SELECT ts, event_id, key, CASE") + f") WHERE ts <= {PASSED}")
def idempotent_in_order(spark, sf):
    """Requests judged in event time: those that the watermark has passed."""
    k = F.get_json_object("props", "$.k")
    e = _event_files(spark, sf).select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", k).alias("key"), "event_id", F.sha2(F.floor("value").cast("string"), 256).alias("request_hash"), F.col("ts").cast("timestamp").alias("ts"))
    return _run(ordered.idempotent_in_order(e, kept_ms=None), close=True, state=ordered.ROCKSDB).select("event_id", "key", "outcome")


@query("SELECT resource_id, event_id, from_status, to_status FROM (" + ORACLES["status_stream"].replace("SELECT user_id AS resource_id,", "SELECT ts, user_id AS resource_id,") + f") WHERE ts <= {PASSED}")
def status_in_order(spark, sf):
    """Status changes judged in event time: those that the watermark has passed."""
    allowed = {(a, b) for a, to in governance.TRANSITIONS["review_task"].items() for b in to}
    e = _event_files(spark, sf).select(F.col("user_id").cast("string").alias("resource_id"), "event_id", F.expr(STATUS).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return _run(ordered.status_in_order(e, allowed, kept_ms=None), close=True, state=ordered.ROCKSDB).select(F.col("resource_id").cast("long").alias("resource_id"), "event_id", "from_status", "to_status")


@query(f"""WITH e AS (SELECT user_id, event_id, ts, event_type IN ('view', 'click') AS claimed, date_trunc('second', ts) + INTERVAL 1 HOUR AS until, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
SELECT CAST(user_id AS VARCHAR) AS job_id, 'queued' AS status, CAST(epoch(until) AS BIGINT) * 1000 AS lease_until FROM e WHERE claimed AND until <= {PASSED} AND (later IS NULL OR later > until)""")
def leases_in_order(spark, sf):
    """Every lease that ended, in event time, before its job's next event."""
    until = (F.unix_seconds(F.col("ts").cast("timestamp")) + 3600) * 1000
    e = _event_files(spark, sf).select(F.col("user_id").cast("string").alias("job_id"), "event_id", F.when(F.col("event_type").isin("view", "click"), "claimed").otherwise("done").alias("status"), F.col("ts").cast("timestamp").alias("ts"), until.alias("lease_until"))
    return _run(ordered.leases_in_order(e, "1 day"), close=True, state=ordered.ROCKSDB)


@query("SELECT page_id, row, col, text FROM (SELECT page_id, unnest([0, 0, 1, 1, 1]) AS row, unnest([0, 2, 0, 1, 2]) AS col, unnest(['head', 'url', 'a', 'b', 'c']) AS text FROM pages)")
def cells_lateral(spark, sf):
    """Cells with spans from a table function, joined laterally."""
    spark.udtf.register("html_cells", reconcile.html_cells)
    table = '<table><tr><td colspan="2">head</td><td>url</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>'
    V.table(spark, sf, "pages").select("page_id", F.lit(table).alias("html")).createOrReplaceTempView("pages_with_tables")
    return spark.sql("select page_id, `row`, col, text from pages_with_tables, lateral html_cells(html)")


assert set(ORACLES) <= set(QUERIES)

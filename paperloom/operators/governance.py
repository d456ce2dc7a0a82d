"""Scope, search under scope, retention, audit chains and fan-out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from datetime import datetime
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text as X
from paperloom.sources.staging import is_small, staged

#: Kinds of resources that retention may remove, and final states.
RETENTION_TYPES = ("archive_document", "evidence_version", "review_task", "answer_script", "answer_response", "dataset_item", "dataset_release", "accessibility_description", "worker_job", "worker_source")
TERMINAL = ("approved", "archived", "cancelled", "completed", "consumed", "expired", "published", "rejected", "released", "retired", "superseded")

#: Allowed changes of status by kind of resource.
TRANSITIONS = {
    **{kind: {"draft": ("published",), "published": ("superseded", "retired"), "superseded": ("retired",)} for kind in ("curriculum_version", "rubric_version", "taxonomy_version", "syllabus_version")},
    "correction_overlay": {"draft": ("reviewed", "rejected"), "reviewed": ("approved", "rejected", "draft"), "approved": ("reverted",), "rejected": ("draft",)},
    "review_task": {"open": ("in_review", "cancelled"), "in_review": ("approved", "changes_requested", "rejected", "cancelled"), "changes_requested": ("in_review", "cancelled")},
    "answer_script": {"draft": ("ready_for_review",), "ready_for_review": ("approved", "changes_requested"), "changes_requested": ("ready_for_review",)},
    "accessibility_description": {"draft": ("approved", "rejected", "needs_specialist"), "needs_specialist": ("approved", "rejected")},
    "dataset_project": {"draft": ("active", "archived"), "active": ("archived",)},
}


def transitions_of(spark, kind: str) -> DataFrame:
    rows = [(a, b) for a, to in TRANSITIONS[kind].items() for b in to]
    return spark.sql("select * from values " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + " as t(from_status, to_status)")


def _or_any(column: str, allowed: Sequence[str]) -> Column:
    return F.lit(True) if "*" in allowed else F.col(column).isNull() | F.col(column).isin(list(allowed))


def apply_scope(resources: DataFrame, tenant: str, subject: str, courses: Sequence[str] = ("*",), units: Sequence[str] = ("*",), student: bool = False) -> DataFrame:
    """Resources that a principal may see: of its tenant, private ones only their creator, within its courses and units; a student's progress only their own."""
    mine = F.col("created_by") == subject
    out = resources.filter((F.col("tenant_id") == tenant) & ((F.coalesce("visibility", F.lit("tenant")) != "private") | mine) & _or_any("course_id", courses) & _or_any("unit_id", units))
    return out.filter((F.col("resource_type") != "student_progress") | mine) if student else out


def apply_scopes(resources: DataFrame, principals: DataFrame) -> DataFrame:
    """Resources seen by each of many principals (subject, tenant_id, courses: an array, ``*`` for all).

    Private rows meet their creator only, all others the principals of their
    tenant and course, so that rows and principals that do not fit never meet.
    """
    each = principals.select("subject", "tenant_id", F.explode("courses").alias("course")).distinct()
    every = each.filter("course = '*'").select("subject", "tenant_id")
    named = each.join(every, ["subject", "tenant_id"], "left_anti")
    private = F.coalesce("visibility", F.lit("tenant")) == "private"
    shared, own = resources.filter(~private), resources.filter(private)
    by_course = shared.join(named.withColumnRenamed("course", "course_id"), ["tenant_id", "course_id"])
    no_course = shared.filter("course_id is null").join(named.select("subject", "tenant_id").distinct(), "tenant_id")
    mine = own.withColumn("subject", F.col("created_by"))
    mine_named = mine.filter("course_id is not null").join(named.withColumnRenamed("course", "course_id"), ["tenant_id", "subject", "course_id"], "left_semi")
    mine_free = mine.filter("course_id is null").join(named, ["tenant_id", "subject"], "left_semi")
    mine_all = mine.join(every, ["tenant_id", "subject"], "left_semi")
    columns = [*resources.columns, "subject"]
    out = by_course.select(*columns)
    for part in (no_course, shared.join(every, "tenant_id"), mine_named, mine_free, mine_all):
        out = out.union(part.select(*columns))
    return out


def scope_counts(resources: DataFrame, principals: DataFrame) -> DataFrame:
    """subject and n: how many resources ``apply_scopes`` shows to each principal that sees any, for all its tenants and courses.

    Rows of one tenant, course and visibility (private ones: and creator) are seen
    by the same principals, so they are counted before they meet them.
    """
    private = F.coalesce("visibility", F.lit("tenant")) == "private"
    alike = resources.groupBy("tenant_id", "course_id", F.when(private, "private").otherwise("tenant").alias("visibility"), F.when(private, F.col("created_by")).alias("created_by")).agg(F.count("*").alias("n"))
    return apply_scopes(alike, principals).groupBy("subject").agg(F.sum("n").alias("n"))


def _payload_meets(rows: DataFrame, asked: list) -> Column:
    """Whether the payload meets all conditions (path, type, test). One parse: the payload is bound to a name that all of them share."""
    payload = F.col("payload") if isinstance(rows.schema["payload"].dataType, T.VariantType) else F.try_parse_json("payload")
    return F.exists(F.array(payload), lambda v: reduce(and_, [F.coalesce(test(F.try_variant_get(v, path, kind)), F.lit(False)) for path, kind, test in asked]))


def search_lexical(resources: DataFrame, query: str = "", resource_type: str | None = None, status: str | None = None, course_id: str | None = None, unit_id: str | None = None, assessment_id: str | None = None, created_by: str | None = None, created_from: datetime | None = None, created_to: datetime | None = None, quality_min: float | None = None, warning_max: int | None = None, language: str | None = None) -> DataFrame:
    """Scoped resources that meet all conditions given; each of the query's first 20 words must stand in title or search_text, in any case.

    payload is a VARIANT, or JSON text, which is then parsed once a row however
    many conditions look into it. A payload that is no JSON, or names a key twice,
    meets no condition.
    """
    for column, value in (("resource_type", resource_type), ("status", status), ("course_id", course_id), ("unit_id", unit_id), ("created_by", created_by)):
        if value is not None:
            resources = resources.filter(F.col(column) == value)
    if created_from is not None:
        resources = resources.filter(F.col("created_at") >= F.lit(created_from))
    if created_to is not None:
        resources = resources.filter(F.col("created_at") <= F.lit(created_to))
    asked = [(path, "string", lambda found, value=value: found == value) for path, value in (("$.assessment_id", assessment_id), ("$.language", language)) if value is not None]
    if quality_min is not None:
        asked.append(("$.quality_score", "double", lambda found: found >= quality_min))
    if warning_max is not None:
        asked.append(("$.warning_count", "double", lambda found: found <= warning_max))
    if asked:
        resources = resources.filter(_payload_meets(resources, asked))
    for term in query.casefold().split()[:20]:
        resources = resources.filter(F.contains(X.fold("title"), F.lit(term)) | F.contains(X.fold("search_text"), F.lit(term)))
    return resources


def retention_candidates(resources: DataFrame, cutoff: datetime, types: Sequence[str] = RETENTION_TYPES) -> DataFrame:
    """Resources of allowed kinds in a final state, not changed since the cutoff and not on legal hold; oldest first. The hold counts before any limit."""
    unknown = set(types) - set(RETENTION_TYPES)
    if unknown:
        raise ValueError(f"retention does not cover {sorted(unknown)}")
    held = F.coalesce(F.get_json_object("payload", "$.legal_hold") == "true", F.lit(False))
    return resources.filter(F.col("resource_type").isin(list(types)) & F.col("status").isin(*TERMINAL) & (F.col("updated_at") < F.lit(cutoff)) & ~held).orderBy("updated_at", "resource_id")


def retention_apply(resources: DataFrame, candidates: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays, an audit row for each row removed, and the distinct storage keys to remove (four places of the payload, the tenant's own only)."""
    gone = candidates.select("resource_id")
    kept = resources.join(gone, "resource_id", "left_anti")
    removed = resources.join(gone, "resource_id", "left_semi")
    audit = removed.select("resource_id", F.lit("retention.deleted").alias("action"), F.sha2(F.concat_ws("\0", "resource_id", "updated_at"), 256).alias("event_id"))
    paths = F.array(*[F.get_json_object("payload", p) for p in ("$.object_key", "$.preview_key", "$.source.object_key", "$.artifact.object_key")])
    keys = removed.select(F.explode(F.array_compact(paths)).alias("object_key")).filter(F.startswith("object_key", F.lit(f"{tenant}/"))).distinct()
    return kept, audit, keys


def student_safe(packs: DataFrame) -> DataFrame:
    """Packs with approved items only, and of them the eight fields that students may see."""
    fields = ("question_id", "text", "topic", "objective", "difficulty", "language", "provenance", "accessibility_description")
    items = F.transform(F.filter("items", lambda i: F.coalesce(i["teacher_approved"], F.lit(False))), lambda i: F.struct(*[i[f].alias(f) for f in fields]))
    return packs.withColumn("items", items)


def verify_audit_chain(events: DataFrame, chain: str = "tenant", recompute: Column | None = None) -> DataFrame:
    """Breaks of the chain: events whose previous_hash is not the hash before (null for the first), or whose hash is not what ``recompute`` gives.

    Chains may be long: events are dealt by ranges of chain and sequence, each
    range looks at its own, and the last hashes of the ranges before it, a few
    for each chain, tell the rest.
    """
    part = "range_of_its_own"
    rows = staged(events.repartitionByRange(F.col(chain), F.col("sequence")).withColumn(part, F.spark_partition_id()))
    own = F.lag("event_hash").over(Window.partitionBy(chain, part).orderBy("sequence"))
    first = F.row_number().over(Window.partitionBy(chain, part).orderBy("sequence")) == 1
    ends = rows.groupBy(chain, part).agg(F.max_by("event_hash", "sequence").alias("last")).groupBy(F.col(chain).alias("of")).agg(F.collect_list(F.struct(F.col(part).alias("part"), "last")).alias("ends"))
    earlier = F.array_max(F.filter("ends", lambda e: e["part"] < F.col(part)))["last"]
    linked = rows.withColumn("own", own).withColumn("first", first).join(ends, F.col("of").eqNullSafe(F.col(chain)))
    linked = linked.withColumn("expected_previous", F.when(F.col("first"), earlier).otherwise(F.col("own"))).select(*events.columns, "expected_previous")
    bad = ~F.col("previous_hash").eqNullSafe(F.col("expected_previous"))
    return linked.filter(bad | (F.col("event_hash") != recompute) if recompute is not None else bad)


def chain_audit(events: DataFrame, chain: str = "tenant", last: DataFrame | None = None) -> DataFrame:
    """New events (chain, sequence, body) with previous_hash and event_hash, after the last hash of each chain (chain, event_hash).

    Hashes follow one another, so each chain's new events are one sorted pass of
    one task, streamed in batches; nothing of a chain is held but its last hash.
    """
    before = events.join(last.select(chain, F.col("event_hash").alias("start")), chain, "left") if last is not None else events.withColumn("start", F.lit(None).cast("string"))
    schema = f"{chain} {events.schema[chain].dataType.simpleString()}, sequence long, body string, previous_hash string, event_hash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, previous = None, None
        for batch in batches:
            rows = []
            for key, sequence, body, start in zip(batch[chain], batch["sequence"], batch["body"], batch["start"], strict=True):
                if key != at:
                    at, previous = key, start if isinstance(start, str) else None
                made = hashlib.sha256(f"{previous or ''}{body}".encode()).hexdigest()
                rows.append((key, sequence, body, previous, made))
                previous = made
            yield pd.DataFrame(rows, columns=[chain, "sequence", "body", "previous_hash", "event_hash"])

    return before.select(chain, F.col("sequence").cast("long").alias("sequence"), "body", "start").repartition(chain).sortWithinPartitions(chain, "sequence").mapInPandas(run, schema)


def subscribed(subscriptions: DataFrame) -> DataFrame:
    """subscription_id and event_type, one row for each; of a subscription to all (``*``) only that one."""
    named = subscriptions.select("subscription_id", F.explode("event_types").alias("event_type")).distinct()
    every = named.filter("event_type = '*'").select("subscription_id")
    return named.filter("event_type = '*'").union(named.join(every, "subscription_id", "left_anti").select("subscription_id", "event_type"))


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """event_id and subscription_id of each event for each subscription that names its action, or all (``*``).

    An event looks up its action and ``*``; no pair comes twice, so nothing is
    made distinct afterwards. A list of subscriptions that is small is broadcast.
    """
    named = subscribed(subscriptions)
    asked = events.select("event_id", F.explode(F.array(F.col("action"), F.lit("*"))).alias("event_type"))
    return asked.join(F.broadcast(named) if is_small(named) else named, "event_type").select("event_id", "subscription_id")


def grade_return_feed(scripts: DataFrame, identities: DataFrame) -> DataFrame:
    """Approved scripts flagged for return and not yet published, with their identity, or the reason why there is none."""
    due = scripts.filter("status = 'approved' and return_grade and published_at is null")
    met = due.join(identities.select("pseudonym", "line_item"), "pseudonym", "left")
    return met.withColumn("reject_reason", F.when(F.col("line_item").isNull(), "identity_not_mapped"))


def rubric_gate(scripts: DataFrame, rubrics: DataFrame, assessments: DataFrame) -> DataFrame:
    """script_id and rule of scripts without a published rubric or an existing assessment."""
    published = rubrics.filter("status = 'published'").select("rubric_id")
    return scripts.join(published, "rubric_id", "left_anti").select("script_id", F.lit("rubric_not_published").alias("rule")).union(scripts.join(assessments.select("assessment_id"), "assessment_id", "left_anti").select("script_id", F.lit("assessment_missing")))


def language_gate(rows: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Rows with what can be relied on in their language; an unknown language can nothing."""
    return rows.join(capabilities, "language", "left").withColumn("question_segmentation", F.coalesce("question_segmentation", F.lit("unsupported")))

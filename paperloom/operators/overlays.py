"""Versioned overlays over immutable evidence: corrections, overrides, staleness, versions, transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.sources.staging import is_small


def line_confidence(*readings: str) -> Column:
    """The first reading that is a number from 0 to 1, four places."""
    numbers = [F.expr(f"try_cast(`{r}` as double)") for r in readings]
    return F.round(F.coalesce(*[F.when(n.between(0, 1), n) for n in numbers]), 4)


def confidence_band(sure: Column) -> Column:
    return F.when(sure.isNull(), "unavailable").when(sure >= 0.9, "high").when(sure >= 0.7, "review").otherwise("low")


def mark_stale(overlays: DataFrame, evidence: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``overlays`` (with source_hash) and whether the evidence's content_hash is another now, or the evidence is gone."""
    now = evidence.select(*keys, F.col("content_hash").alias("current_hash"))
    return overlays.join(now, list(keys), "left").withColumn("stale", ~F.col("source_hash").eqNullSafe(F.col("current_hash"))).drop("current_hash")


def accepted(corrections: DataFrame) -> DataFrame:
    return corrections.filter((F.col("status") == "approved") & ~F.coalesce("stale", F.lit(False)))


def _one_a_target(corrections: DataFrame, kinds: Sequence[str], keys: Sequence[str] = ("doc_id", "target_id")) -> DataFrame:
    """One correction a target: the earliest kind of ``kinds``, and of one kind the last version."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("target_kind"))
    best = corrections.filter(F.col("target_kind").isin(list(kinds))).groupBy(*keys).agg(F.min_by(F.struct("correction_id", "replacement"), F.struct(rank, -F.col("version"), "correction_id")).alias("c"))
    return best.select(*keys, "c.*")


def effective_lines(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Lines with approved, fresh overlays in place of their text; raw_text, corrected, correction_id, confidence and band beside it."""
    chosen = _one_a_target(accepted(corrections), ("line", "block")).withColumnRenamed("target_id", "line_id")
    sure = line_confidence(*[c for c in ("retry_confidence", "confidence", "score") if c in lines.columns])
    return (
        lines.join(chosen, ["doc_id", "line_id"], "left")
        .withColumn("raw_text", F.coalesce("text", F.lit("")))
        .withColumn("text", F.coalesce("replacement", "raw_text"))
        .withColumn("corrected", F.col("correction_id").isNotNull())
        .withColumn("confidence", sure)
        .withColumn("confidence_band", confidence_band(F.col("confidence")))
        .withColumn("normalized_bbox", G.valid_box("normalized_bbox"))
        .drop("replacement")
    )


def reconstructed_text(effective: DataFrame, corrections: DataFrame) -> DataFrame:
    """doc_id and text: the document's overlay, or its non-blank effective lines in order."""
    whole = _one_a_target(accepted(corrections).filter("target_id = 'document'"), ("reconstructed_text",), ("doc_id",)).select("doc_id", F.col("replacement").alias("whole"))
    joined = effective.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("seq", "text")))), lambda s: s["text"]).alias("parts"))
    return joined.join(whole, "doc_id", "left").select("doc_id", F.coalesce("whole", F.array_join("parts", "\n")).alias("text"))


def effective_questions(questions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Questions with approved overlays on text and on marks (whole, 0 to 100)."""
    fresh = accepted(corrections)
    text = _one_a_target(fresh, ("question",)).select("doc_id", F.col("target_id").alias("question_id"), F.col("replacement").alias("new_text"))
    marks = _one_a_target(fresh, ("marks",)).select("doc_id", F.col("target_id").alias("question_id"), F.expr("try_cast(replacement as int)").alias("new_marks")).filter("new_marks between 0 and 100")
    keys = ["doc_id", "question_id"]
    return (
        questions.join(text, keys, "left").join(marks, keys, "left")
        .withColumn("raw_text", F.col("text")).withColumn("raw_marks", F.col("marks"))
        .withColumn("text", F.coalesce("new_text", "text"))
        .withColumn("marks_status", F.when(F.col("new_marks").isNotNull(), "teacher_approved_overlay").otherwise(F.col("marks_status")))
        .withColumn("marks", F.coalesce("new_marks", "marks")).drop("new_text", "new_marks")
    )


def lines_to_questions(questions: DataFrame) -> DataFrame:
    """doc_id, question_id, marks and line_id, a row for each line of a question."""
    return questions.select("doc_id", "question_id", "marks", F.explode("source_line_ids").alias("line_id"))


def unmapped_questions(questions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Questions without an approved mapping."""
    return questions.join(mappings.filter("status = 'approved'").select("doc_id", "question_id"), ["doc_id", "question_id"], "left_anti")


def evidence_types(lines: DataFrame, questions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Lines with the sorted kinds of evidence that they are: text, and question, marks, unmapped, table, figure where they hold."""
    mapped = mappings.filter("status = 'approved'").select("doc_id", "question_id").distinct().withColumn("mapped", F.lit(True))
    linked = lines_to_questions(questions).join(mapped, ["doc_id", "question_id"], "left").groupBy("doc_id", "line_id").agg(
        F.bool_or(F.col("marks").isNotNull()).alias("has_marks"), F.bool_or(F.col("mapped").isNull()).alias("is_unmapped")
    )
    kind = F.lower(F.col("block_type")) if "block_type" in lines.columns else F.lit("")
    found = [
        F.lit("text"), F.when(F.col("has_marks").isNotNull(), "question"), F.when(F.col("has_marks"), "marks"), F.when(F.col("is_unmapped"), "unmapped"),
        F.when(kind.contains("table"), "table"), F.when(kind.rlike("figure|image|chart|diagram"), "figure"),
    ]
    return lines.join(linked, ["doc_id", "line_id"], "left").withColumn("evidence_types", F.array_sort(F.array_compact(F.array(*found)))).drop("has_marks", "is_unmapped")


def review_issues(effective: DataFrame) -> DataFrame:
    """Effective lines to look at: no confidence, under 0.9, or corrected."""
    wanted = F.col("confidence").isNull() | (F.col("confidence") < 0.9) | F.col("corrected")
    return effective.filter(wanted).select(
        "doc_id", F.concat(F.lit("issue-"), "line_id").alias("issue_id"), "line_id", "page_number", "text", "confidence", "confidence_band",
        F.when(F.col("corrected"), "approved").otherwise("uncorrected").alias("correction_status"), F.col("normalized_bbox").isNotNull().alias("geometry_available"),
    )


def effective_value(field: str, teacher: str = "teacher_override", ai: str = "ai") -> Column:
    """A teacher's value wins where its key is present, even if it is null. Both columns are maps."""
    return F.when(F.coalesce(F.map_contains_key(teacher, field), F.lit(False)), F.try_element_at(teacher, F.lit(field))).otherwise(F.try_element_at(F.col(ai), F.lit(field)))


def carry_over(new: DataFrame, prior: DataFrame) -> DataFrame:
    """New questions with the teacher's override and review status of the prior question of the same id."""
    kept = prior.select("doc_id", "question_id", F.col("teacher_override").alias("kept"), F.col("review_status").alias("kept_status"))
    fresh = new.drop("teacher_override") if "teacher_override" in new.columns else new
    return fresh.join(kept, ["doc_id", "question_id"], "left").withColumn("review_status", F.coalesce("kept_status", "review_status")).withColumnRenamed("kept", "teacher_override").drop("kept_status")


def latest_version(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The row of the highest version of each key."""
    rows = versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), version).alias("row"))
    return rows.select("row.*")


def next_version(versions: DataFrame, key: str, order: str, status: str = "status") -> DataFrame:
    """Versions counted from 1 in order; a published one is superseded once a later one is published."""
    line = Window.partitionBy(key).orderBy(order)
    later = F.max((F.col(status) == "published").cast("int")).over(line.rowsBetween(1, Window.unboundedFollowing))
    state = F.when((F.col(status) == "published") & (F.coalesce(later, F.lit(0)) == 1), "superseded").otherwise(F.col(status))
    return versions.withColumn("version", F.row_number().over(line)).withColumn("effective_status", state)


def check_transitions(events: DataFrame, allowed: DataFrame, key: str, order: str, status: str = "status") -> DataFrame:
    """Status changes of a key that ``allowed`` (from_status, to_status) does not name; a first status and a repeated one are allowed."""
    steps = events.withColumn("from_status", F.lag(status).over(Window.partitionBy(key).orderBy(order))).withColumn("to_status", F.col(status))
    moved = steps.filter("from_status is not null and from_status <> to_status")
    named = allowed.select("from_status", "to_status").distinct()
    return moved.join(F.broadcast(named) if is_small(named) else named, ["from_status", "to_status"], "left_anti")


def version_conflicts(updates: DataFrame, key: str, order: str, version: str = "version") -> DataFrame:
    """Updates that do not carry the version after the one before them."""
    before = F.lag(version).over(Window.partitionBy(key).orderBy(order))
    return updates.withColumn("current_version", F.coalesce(before, F.lit(0))).filter(F.col(version) != F.col("current_version") + 1)


CORRECTION_KINDS = ("line", "block", "reconstructed_text", "question", "marks", "table_cell")
CORRECTION_STATUS = ("draft", "reviewed", "approved", "rejected", "reverted")


def _violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row (key, rule) for each rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(rule)) for rule, bad in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def validate_corrections(corrections: DataFrame, lines: DataFrame) -> DataFrame:
    """correction_id and rule of each broken rule: kind, status, target and reason lengths, geometry, and a line that is not there."""
    found = _violations(corrections, "correction_id", {
        "kind": ~F.col("target_kind").isin(*CORRECTION_KINDS), "status": ~F.col("status").isin(*CORRECTION_STATUS),
        "target": ~F.length("target_id").between(1, 256), "reason": ~F.length(F.trim(F.coalesce("reason", F.lit("")))).between(1, 1000),
        "geometry": F.col("geometry").isNotNull() & G.valid_box("geometry").isNull() if "geometry" in corrections.columns else F.lit(False),
    })
    lost = corrections.filter(F.col("target_kind").isin("line", "block")).join(lines.select("doc_id", F.col("line_id").alias("target_id")), ["doc_id", "target_id"], "left_anti")
    return found.union(lost.select("correction_id", F.lit("missing_target")))


def validate_mappings(mappings: DataFrame) -> DataFrame:
    """Mappings that no teacher made and that are more than drafts."""
    return mappings.filter((F.col("method") != "teacher") & (F.col("status") != "draft"))


#: What a teacher may override.
OVERRIDE_FIELDS = ("topic", "subtopic", "difficulty", "difficulty_reason", "cognitive_skill", "marks", "review_status")
DIFFICULTIES = ("low", "medium", "high", "unclassified")
REVIEW_STATUSES = ("needs_teacher_review", "teacher_reviewed", "approved")


def validate_overrides(overrides: DataFrame) -> DataFrame:
    """question_id and rule of overrides (a map of strings): unknown field, difficulty, status, marks from 0 to 100."""
    given = lambda f: F.try_element_at(F.col("override"), F.lit(f))
    marks = F.expr("try_cast(try_element_at(override, 'marks') as int)")
    return _violations(overrides, "question_id", {
        "field": F.size(F.array_except(F.map_keys("override"), F.array(*map(F.lit, OVERRIDE_FIELDS)))) > 0,
        "difficulty": given("difficulty").isNotNull() & ~given("difficulty").isin(*DIFFICULTIES),
        "status": given("review_status").isNotNull() & ~given("review_status").isin(*REVIEW_STATUSES),
        "marks": given("marks").isNotNull() & ~F.coalesce(marks.between(0, 100), F.lit(False)),
    })


def validate_ranges(rows: DataFrame, key: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """key and rule of rows whose range ends before it begins."""
    return _violations(rows, key, {f"{a}>{b}": F.coalesce(F.col(b) < F.col(a), F.lit(False)) for a, b in pairs})

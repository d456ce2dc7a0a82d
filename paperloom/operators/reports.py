"""Corpus reports, dashboards, metrics and bounded listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators.overlays import effective_value


def paper_analysis(questions: DataFrame) -> DataFrame:
    """A row for each document and topic (null: Unclassified): its questions, marks and ids, whether it is a priority, and the document's totals."""
    topic = questions.withColumn("topic", F.coalesce(F.nullif(F.trim("topic"), F.lit("")), F.lit("Unclassified")))
    per = topic.groupBy("doc_id", "topic").agg(
        F.count("*").alias("question_count"), F.sum(F.coalesce("marks", F.lit(0))).alias("marks_total"), F.array_sort(F.collect_list("question_id")).alias("question_ids"),
        *[F.count_if(F.coalesce("difficulty", F.lit("unclassified")) == d).alias(f"n_{d}") for d in ("low", "medium", "high", "unclassified")],
    )
    whole = Window.partitionBy("doc_id")
    return per.withColumn("priority", F.col("topic") != "Unclassified").withColumn("document_questions", F.sum("question_count").over(whole)).withColumn("document_marks", F.sum("marks_total").over(whole))


def recurring_topics(questions: DataFrame) -> DataFrame:
    """Topics of more than one question over the whole corpus, most frequent first."""
    return questions.groupBy("topic").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("papers")).filter("occurrences > 1").orderBy(F.desc("occurrences"), "topic")


def compare_papers(questions: DataFrame, corrections: DataFrame, mappings: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row for each paper: questions, marks, low confidence (under 0.7), unmapped, approved mappings, pending corrections, quality and warnings."""
    per = questions.groupBy("doc_id").agg(
        F.count("*").alias("question_count"), F.sum(F.coalesce("marks", F.lit(0))).alias("marks_total"), F.count_if(F.col("ocr_confidence") < 0.7).alias("low_confidence"),
        F.count_if(F.coalesce("topic", F.lit("Unmapped")) == "Unmapped").alias("unmapped"),
    )
    approved = mappings.filter("status = 'approved'").groupBy("doc_id").agg(F.count("*").alias("approved_mappings"))
    pending = corrections.filter("status in ('draft', 'reviewed')").groupBy("doc_id").agg(F.count("*").alias("pending_corrections"))
    out = per.join(approved, "doc_id", "left").join(pending, "doc_id", "left").join(jobs.select("doc_id", "quality_score", "warning_count"), "doc_id", "left")
    return out.fillna(0, ["approved_mappings", "pending_corrections"])


def distributions(questions: DataFrame, fields: tuple[str, ...] = ("topic", "difficulty", "cognitive_skill", "question_type")) -> DataFrame:
    """field, value and question_count over the corpus, all fields in one pass over the questions."""
    named = questions.select(*[F.coalesce(F.col(f), F.lit("Unmapped" if f == "topic" else "unclassified")).alias(f) for f in fields])
    sets = ", ".join(f"({f})" for f in fields)
    view = "{q}"
    rows = questions.sparkSession.sql(f"select {', '.join(fields)}, count(*) as question_count, grouping_id({', '.join(fields)}) as g from {view} group by grouping sets ({sets})", q=named)
    code = lambda i: (1 << len(fields)) - 1 - (1 << (len(fields) - 1 - i))
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(fields):
        field, value = F.when(F.col("g") == code(i), f).otherwise(field), F.when(F.col("g") == code(i), F.col(f)).otherwise(value)
    return rows.select(field.alias("field"), value.alias("value"), "question_count")


def topic_of(teacher: str = "teacher_override", ai: str = "ai") -> Column:
    return F.coalesce(effective_value("topic", teacher, ai), F.lit("Unmapped"))


def dashboard_counts(corrections: DataFrame, jobs: DataFrame, bank: DataFrame, batches: DataFrame, questions: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row of counts: pending corrections, jobs under 0.70, bank items pending and approved, active batches, unmapped questions."""
    one = lambda df, *aggs: df.agg(*aggs)
    parts = [
        one(corrections, F.count_if(F.col("status").isin("draft", "reviewed")).alias("pending_corrections")),
        one(jobs, F.count_if(F.col("quality_score") < 0.70).alias("low_quality_jobs")),
        one(bank, F.count_if(F.col("status").isin("draft", "reviewed")).alias("bank_pending"), F.count_if(F.col("status") == "approved").alias("bank_approved")),
        one(batches, F.count_if(F.col("status").isin("queued", "processing", "paused")).alias("active_batches")),
        one(questions, F.count("*").alias("n_questions")),
        one(mappings.select("doc_id", "question_id").distinct(), F.count("*").alias("n_mapped")),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:  # each side is one row
        out = out.join(p.withColumn("one", F.lit(1)), "one")
    return out.withColumn("unmapped_questions", F.greatest(F.lit(0), F.col("n_questions") - F.col("n_mapped"))).drop("one", "n_questions", "n_mapped")


def queue_counts(resources: DataFrame, queues: dict[str, Column]) -> DataFrame:
    """Counts of the named conditions over resources already in scope."""
    return resources.agg(*[F.count_if(c).alias(n) for n, c in queues.items()])


def benchmark_report(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """case_count and each metric's mean over values that are neither null nor negative, six places."""
    return scores.agg(F.count("*").alias("case_count"), *[F.round(F.avg(F.when(F.col(m) >= 0, F.col(m))), 6).alias(m) for m in metrics])


def score_cases(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Metrics of each expected case (case_id, text, question_numbers, reading_order, tables, figures, equations) against its result.

    A result has full_text, display_numbers, line_order, n_tables, n_figures,
    n_equations and questions (question_id, source_page, source_line_ids, ai: the
    same three). A case without a result is an error row with null metrics.
    """
    met = expected.alias("e").join(actual.alias("a"), "case_id", "left")
    col = lambda s, c: F.col(f"{s}.{c}")
    there = col("a", "full_text").isNotNull()
    q = col("a", "questions")
    traced = F.filter(q, lambda x: (x["source_page"] > 0) & (F.size(x["source_line_ids"]) > 0))
    reviewed = F.filter(q, lambda x: x["ai"].isNotNull())
    grounded = F.filter(reviewed, lambda x: (F.size(x["ai"]["source_line_ids"]) > 0) & (F.size(F.array_except(x["ai"]["source_line_ids"], x["source_line_ids"])) == 0) & x["ai"]["source_page"].eqNullSafe(x["source_page"]) & x["ai"]["question_id"].eqNullSafe(x["question_id"]))
    metrics = {
        "character_error_rate": X.character_error_rate(col("e", "text"), col("a", "full_text")), "word_error_rate": X.word_error_rate(col("e", "text"), col("a", "full_text")),
        "question_number_accuracy": X.positional_accuracy(col("e", "question_numbers"), col("a", "display_numbers")), "reading_order_accuracy": X.positional_accuracy(col("e", "reading_order"), col("a", "line_order")),
        **{f"{n[:-1]}_handling_accuracy": X.handling_accuracy(col("e", n), col("a", f"n_{n}")) for n in ("tables", "figures", "equations")},
        "source_traceability": F.round(F.size(traced) / F.greatest(F.size(q), F.lit(1)), 6), "ai_grounding_rate": F.when(F.size(reviewed) > 0, F.round(F.size(grounded) / F.size(reviewed), 6)),
    }
    return met.select("case_id", F.when(there, None).otherwise("missing_result").alias("error"), *[F.when(there, m).alias(n) for n, m in metrics.items()])


def delivery_counts(deliveries: DataFrame) -> DataFrame:
    """Deliveries by outcome."""
    return deliveries.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("delivered", "pending", "failed")], F.count("*").alias("total"))


def sync_counts(outcomes: DataFrame) -> DataFrame:
    """One row of counts of a sync run (ok: true, false, or null where nothing was sent): completed, and pending_after_error."""
    return outcomes.agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("completed"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("pending_after_error"))


def feature_counts() -> dict[str, Column]:
    """n_tables, n_figures and n_equations of a result: the count that it states, else its list, else (figures, equations) its elements of such a type."""
    listed = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    typed = lambda *kinds: F.coalesce(F.size(F.filter("elements", lambda e: F.lower(e["type"]).isin(*kinds))), F.lit(0))
    stated = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return {
        "n_tables": F.coalesce(stated("table_count"), listed("tables")),
        "n_figures": F.coalesce(stated("figure_count"), F.nullif(listed("figures"), F.lit(0)), typed("figure", "image")),
        "n_equations": F.coalesce(stated("equation_count"), F.nullif(listed("equations"), F.lit(0)), typed("equation", "formula")),
    }


def document_profiles(elements: DataFrame, requested: str = "auto") -> DataFrame:
    """doc_id and document_profile of elements (doc_id, seq, page_index, content): exam where the first two pages hold three signs of one, of which sub-questions give three at most."""
    if requested != "auto":
        return elements.select("doc_id", F.lit(requested).alias("document_profile")).distinct()
    early = F.when(F.coalesce("page_index", F.lit(0)) <= 1, F.struct("seq", F.coalesce("content", F.lit("")).alias("content")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(early)), lambda s: s["content"]), "\n")
    pages = elements.groupBy("doc_id").agg(text.alias("text"))
    found = lambda pattern: F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    signs = found(X.EXAM_SIGNAL) + F.least(found(X.SUBQUESTION), F.lit(3))
    return pages.select("doc_id", F.when(signs >= 3, "exam").otherwise("general").alias("document_profile"))


def retry_summary(pages: DataFrame) -> DataFrame:
    """doc_id with the sums of adaptive retries attempted and accepted."""
    return pages.groupBy("doc_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("adaptive_retry_attempted", "adaptive_retry_accepted")])


def legacy_topics(*topics: DataFrame) -> DataFrame:
    """Taxonomy rows under one root of all topics that taxonomies, teachers and models named; ids are hashes of the folded label."""
    named = topics[0].select("topic")
    for t in topics[1:]:
        named = named.union(t.select("topic"))
    trimmed = named.select(F.trim("topic").alias("label")).filter("label <> ''")
    per = trimmed.groupBy(F.lower("label").alias("folded")).agg(F.min("label").alias("label"))
    return per.select(F.concat(F.lit("legacy-"), F.substring(F.sha2("folded", 256), 1, 16)).alias("node_id"), F.lit("legacy-root").alias("parent_id"), "label")


def practice_starters(questions: DataFrame, most: int = 20, cut: int = 900) -> DataFrame:
    """The first questions of each document as starters, their text cut."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no"))
    return questions.withColumn("place", place).filter(F.col("place") <= most).select("doc_id", "place", "question_id", F.format_string("Practise: %s", F.substring("text", 1, cut)).alias("starter"))


def analysis_markdown(questions: DataFrame) -> DataFrame:
    """doc_id and a Markdown report of its questions in order: text, source page and lines, confidence, topic, difficulty and marks."""
    said = lambda c, otherwise: F.coalesce(F.col(c).cast("string"), F.lit(otherwise))
    part = F.concat(
        F.lit("### "), "display_number", F.lit("\n\n"), X.escape_markdown("text"), F.lit("\n\nSource: page "), said("source_page", "not known"), F.lit(", lines "), F.array_join("source_line_ids", ", "),
        F.lit("\nConfidence: "), said("ocr_confidence", "not available"), F.lit("\nTopic: "), said("topic", "Unclassified"), F.lit("\nDifficulty: "), said("difficulty", "Unclassified"), F.lit("\nMarks: "), said("marks", "not detected"), F.lit("\n"),
    )
    rows = questions.select("doc_id", "group_no", part.alias("part"))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("# Question analysis\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "part"))), lambda s: s["part"]), "\n")).alias("markdown"))

"""Ordered operators over recognised lines: questions, answers, paragraphs, reading order.

What looks sequential is a start flag, its running sum as a group number and an
aggregation, so each takes one shuffle on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as X


def _in_order(value: str, order: str, sep: str = " ") -> Column:
    """Aggregate: the values joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), sep)


def _record(seq: str) -> list[Column]:
    """Aggregates of a question's lines (columns ``seq``, part, line_id, page_number, confidence, box)."""
    sure = F.col("confidence").cast("double")
    return [
        X.clean(_in_order("part", seq)).alias("text"),
        F.min_by("page_number", seq).alias("source_page"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("line_id").isNotNull(), F.struct(seq, "line_id")))), lambda s: s["line_id"]).alias("source_line_ids"),
        G.union_box("box").alias("source_bbox"),
        F.round(F.avg(F.when(sure.between(0, 1), sure)), 4).alias("ocr_confidence"),
    ]


def _numbered(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their question's running number (0: before the first)."""
    line = lines.withColumn("t", X.clean("text")).filter("t <> ''").withColumn("number", X.question_number("t"))
    upto = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("group_no", F.sum(F.col("number").isNotNull().cast("int")).over(upto))


def segment_questions(lines: DataFrame) -> DataFrame:
    """Questions of each document's lines (doc_id, seq, line_id, page_number, text, confidence, normalized_bbox).

    A line that starts with a number starts a question, the lines after it
    belong to it, blank ones are dropped. Lines before the first question are not
    attached (see ``preambles``). A document without any number gives one record
    over all its lines. Ids may repeat over different numbers; group_no is the key.
    """
    line = lines.withColumn("box", G.valid_box("normalized_bbox")).withColumn("t", X.clean("text")).withColumn("number", F.when(F.col("t") != "", X.question_number("t")))
    starts, doc = F.col("number").isNotNull().cast("int"), Window.partitionBy("doc_id")
    line = line.withColumn("group_no", F.sum(starts).over(doc.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum(starts).over(doc))
    loose = F.col("n") == 0
    part = F.when(F.col("number").isNotNull(), F.coalesce(F.nullif(X.after_number("t"), F.lit("")), F.col("t"))).otherwise(F.col("t"))
    held = line.filter(loose | ((F.col("t") != "") & (F.col("group_no") > 0))).withColumn("part", part).withColumn("group_no", F.when(loose, F.lit(1).cast("long")).otherwise(F.col("group_no")))
    found = held.groupBy("doc_id", "group_no").agg(F.coalesce(F.max("number"), F.lit("Unnumbered 1")).alias("display_number"), *_record("seq"), F.max("n").alias("n"))
    base = F.when(loose, "q-unstructured-1").otherwise(X.slug("display_number"))
    found = found.withColumn("base", F.when(base == "q-", F.concat(F.lit("q-"), F.col("group_no"))).otherwise(base))
    again = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("group_no"))
    found = found.withColumn("again", again)
    found = found.withColumn("question_id", F.when(F.col("again") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "again"))).drop("base", "again", "n")
    value = X.marks("text")
    return (
        found.withColumn("marks", value)
        .withColumn("marks_status", F.when(value.isNotNull(), "explicit").otherwise("not_detected"))
        .withColumn("review_status", F.lit("needs_teacher_review"))
        .withColumn("segmentation_source", F.lit("deterministic_ocr_evidence"))
    )


def preambles(lines: DataFrame) -> DataFrame:
    """doc_id and preamble_text of the documents whose text starts before their first question, or that have none."""
    return _numbered(lines).filter("group_no = 0").groupBy("doc_id").agg(_in_order("t", "seq").alias("preamble_text"))


def segmentation_warnings(lines: DataFrame) -> DataFrame:
    """doc_id and warning: unnumbered documents, text before the first question, questions without text."""
    questions = segment_questions(lines)
    return (
        questions.filter("question_id = 'q-unstructured-1'").select("doc_id", F.lit("unnumbered").alias("warning"))
        .union(preambles(lines).select("doc_id", F.lit("preamble")))
        .union(questions.filter("text = ''").select("doc_id", F.concat(F.lit("no_text:"), "question_id")))
    )


#: Fixed value: how a response line names its question.
ANSWER_MARKER = r"(?i)^\s*(?:question\s+)?(\d+(?:\s*\([a-z0-9ivx]+\))?|[a-z])\s*[.):\-]"


def align_answers(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """Each question (script_id, question_id, display_number) and the response lines (script_id, seq, line_id, page, text, ocr_confidence) that answer it.

    A line that names a question turns to it, one that names an unknown number
    does not; a script with one question starts there. Lines before any question
    are left out (``unassigned`` counts them for each script).
    """
    plain = lambda c: F.regexp_replace(X.fold(F.regexp_replace(c, r"\s+", "")), r"[.)]+$", "")
    keyed = questions.select("script_id", "question_id", plain(F.col("display_number")).alias("number")).groupBy("script_id", "number").agg(F.max("question_id").alias("named"))
    only = questions.groupBy("script_id").agg(F.count("*").alias("n"), F.min("question_id").alias("only")).select("script_id", F.when(F.col("n") == 1, F.col("only")).alias("only"))
    marked = responses.withColumn("number", F.nullif(plain(F.regexp_extract("text", ANSWER_MARKER, 1)), F.lit("")))
    marked = marked.join(keyed, ["script_id", "number"], "left").join(only, "script_id", "left")
    upto = Window.partitionBy("script_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("question_id", F.coalesce(F.last("named", ignorenulls=True).over(upto), "only"))
    answers = placed.filter("question_id is not null").groupBy("script_id", "question_id").agg(
        _in_order("text", "seq", "\n").alias("response_text"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "line_id"))), lambda s: s["line_id"]).alias("response_line_ids"),
        F.array_sort(F.collect_set("page")).alias("source_pages"),
        F.round(F.avg("ocr_confidence"), 4).alias("ocr_confidence"),
        F.bool_or(F.coalesce(F.col("named") == F.col("question_id"), F.lit(False))).alias("explicit"),
    )
    out = questions.select("script_id", "question_id", "display_number").join(answers, ["script_id", "question_id"], "left")
    sure = F.when(F.col("explicit"), 0.95).when(F.col("response_line_ids").isNotNull(), 0.75).otherwise(0.0)
    return out.withColumn("alignment_confidence", sure).withColumn("response_text", F.coalesce("response_text", F.lit(""))).withColumn("review_status", F.lit("needs_teacher_review")).drop("explicit")


def reading_order(elements: DataFrame) -> DataFrame:
    """Elements with their place in the document: page, then top, left and index; those without a box last on their page."""
    box = F.col("normalized_bbox")
    order = Window.partitionBy("doc_id").orderBy("page_number", F.get(box, F.lit(1)).asc_nulls_last(), F.get(box, F.lit(0)).asc_nulls_last(), "seq")
    return elements.withColumn("place", F.row_number().over(order))


def line_ranges(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_start and line_end of pages with n_lines."""
    upto = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("line_end", F.sum("n_lines").over(upto)).withColumn("line_start", F.col("line_end") - F.col("n_lines"))


def combine_pages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (full_text, page_count) and pages (line_start, line_end, full_text) of lines in order."""
    pages = lines.groupBy("doc_id", "page_number").agg(F.count("*").alias("n_lines"), _in_order("text", "seq", "\n").alias("full_text"))
    documents = lines.groupBy("doc_id").agg(_in_order("text", "seq", "\n").alias("full_text"), F.countDistinct("page_number").alias("page_count"))
    return documents, line_ranges(pages)


def classify_exam_lines(lines: DataFrame) -> DataFrame:
    """Lines with type question (they start like one), heading (short, above the page's first question) or text."""
    starts = F.trim("text").rlike(X.QUESTION_START)
    top = F.get("normalized_bbox", F.lit(1))
    first = F.coalesce(F.min(F.when(starts, F.coalesce(top, F.lit(1.0)))).over(Window.partitionBy("doc_id", "page_number")), F.lit(0.28))
    return lines.withColumn("type", F.when(starts, "question").when((top < F.least(F.lit(0.25), first)) & (F.length(F.trim("text")) <= 100), "heading").otherwise("text"))


def join_paragraph_lines(lines: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, page_number, paragraph, content, type, line_ids, confidence, box of the last line) of typed lines in order.

    A text line joins the block before it where it lies closely below, is hardly
    indented against its last line and does not start a question; headings take no line.
    """
    page = Window.partitionBy("doc_id", "page_number").orderBy("seq")
    box, prior = F.col("normalized_bbox"), F.lag("normalized_bbox").over(page)
    height = F.greatest(F.lit(0.001), F.get(prior, F.lit(3)) - F.get(prior, F.lit(1)))
    gap, indent = F.get(box, F.lit(1)) - F.get(prior, F.lit(3)), F.abs(F.get(box, F.lit(0)) - F.get(prior, F.lit(0)))
    near = gap.between(-height, height * 1.8) & (indent <= 0.14)
    joins = F.coalesce(near & (F.col("type") == "text") & F.lag("type").over(page).isin("text", "question") & (F.trim("text") != "") & ~F.trim("text").rlike(X.QUESTION_START), F.lit(False))
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    grouped = lines.withColumn("joins", joins).withColumn("paragraph", F.sum((~F.col("joins")).cast("int")).over(upto))
    return grouped.groupBy("doc_id", "page_number", "paragraph").agg(
        _in_order("text", "seq").alias("content"), F.min_by("type", "seq").alias("type"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "line_id"))), lambda s: s["line_id"]).alias("line_ids"),
        F.min("confidence").alias("confidence"), F.max_by("normalized_bbox", "seq").alias("normalized_bbox"),
    )


#: A line that is an image, and how lines that name the source begin.
IMAGE_LINE = r"^(\s*!\[)(.*?)(\]\([^)]+\).*)$"
SOURCE_LINES = ("Source file:", "## Source page ")


def remove_from_markdown(documents: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, markdown without the terms, and how many were removed, of documents (doc_id, markdown).

    The first line, source and source-page lines and display formulas stay; of an
    image only the alternative text changes. A line that loses its words is
    tidied, and one of which no more than a mark is left is emptied.
    """
    line = documents.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("seq", "line")).withColumn("bare", F.trim("line"))
    upto = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.col("bare") == "$$"
    fences = F.sum(marker.cast("int")).over(upto)
    kept = marker | (fences % 2 == 1) | (F.col("seq") == 0) | F.startswith("bare", F.lit(SOURCE_LINES[0])) | F.startswith("bare", F.lit(SOURCE_LINES[1]))
    image = IMAGE_LINE
    alone = F.col("bare").startswith("![") & F.col("line").rlike(image) & ~marker & (fences % 2 == 0)
    target = F.when(alone, F.regexp_extract("line", image, 2)).when(kept, F.lit("")).otherwise(F.col("line"))
    marked = line.withColumn("alone", alone).withColumn("target", target).withColumn("n", F.when(F.col("target") == "", 0).otherwise(X.count_terms("target", terms)))
    bare = X.without_terms("target", terms)
    changed = F.when(F.col("alone"), F.concat(F.regexp_extract("line", image, 1), F.trim(bare), F.regexp_extract("line", image, 3))).otherwise(X.tidy_line(bare))
    parts = marked.select("doc_id", F.struct("seq", F.when(F.col("n") > 0, changed).otherwise(F.col("line")).alias("line")).alias("part"), "n")
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]), "\n").alias("markdown"), F.sum("n").cast("long").alias("removed"))
    return joined.select("doc_id", F.regexp_replace("markdown", r"\n{4,}", "\n\n\n").alias("markdown"), "removed")

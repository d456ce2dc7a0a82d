"""Hooks for models: questions are classified and pages are read by functions that the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Difficulties that a model may name.
DIFFICULTIES = ("low", "medium", "high", "unclassified")
AI = "question_id string, ai_question_id string, ai_source_page int, ai_source_line_ids array<string>, topic string, difficulty string, model string"


def validate_grounding(questions: DataFrame, ai: DataFrame) -> DataFrame:
    """Model rows with a verdict: unknown_question, repeated_question, wrong_page, ungrounded_lines (not a non-empty subset of the question's), bad_difficulty, or ok."""
    from pyspark.sql import Window

    q = questions.select("doc_id", "question_id", F.col("source_page").alias("q_page"), F.col("source_line_ids").alias("q_lines"))
    met = ai.join(q, ["doc_id", "question_id"], "left").withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "question_id").orderBy("ai_source_page", "topic")) > 1)
    lines = F.coalesce("ai_source_line_ids", F.array().cast("array<string>"))
    verdict = (
        F.when(F.col("q_lines").isNull(), "unknown_question").when(F.col("again"), "repeated_question").when(~F.col("ai_source_page").eqNullSafe(F.col("q_page")), "wrong_page")
        .when((F.size(lines) == 0) | (F.size(F.array_except(lines, "q_lines")) > 0), "ungrounded_lines").when(~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)), "bad_difficulty").otherwise("ok")
    )
    return met.withColumn("verdict", verdict).drop("q_page", "q_lines", "again")


Classify = Callable[[pd.DataFrame], pd.DataFrame]


def enrich_questions(questions: DataFrame, classify: Classify, fallback: Classify | None = None, consent: str = "consent") -> DataFrame:
    """Grounded model rows of the questions whose ``consent`` is true: batches go to ``classify``, and to ``fallback`` where it fails.

    A function takes question_id, text, source_page and source_line_ids, and
    returns question_id, source_page, source_line_ids, topic and difficulty.
    Rows that fail ``validate_grounding`` keep their verdict and must not be used.
    """
    kind = questions.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model = "primary"
            try:
                out = classify(batch)
            except Exception:  # noqa: BLE001  the user's function may fail in any way
                if fallback is None:
                    raise
                out, model = fallback(batch), "fallback"
            doc = dict(zip(batch["question_key"], batch["doc_id"], strict=True))
            yield pd.DataFrame({
                "doc_id": [doc.get(k) for k in out["question_key"]], "question_id": out["question_id"], "ai_source_page": out["source_page"], "ai_source_line_ids": out["source_line_ids"],
                "topic": out["topic"], "difficulty": out["difficulty"], "model": model,
            })

    asked = questions.filter(F.col(consent)).select("doc_id", "question_id", F.concat_ws(":", F.col("doc_id").cast("string"), "question_id").alias("question_key"), "text", "source_page", "source_line_ids")
    rows = asked.mapInPandas(run, f"doc_id {kind}, question_id string, ai_source_page int, ai_source_line_ids array<string>, topic string, difficulty string, model string")
    return validate_grounding(questions, rows)


#: Pages of a batch whose lines are in memory together.
PAGES_TOGETHER = 64


def few_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of Arrow batches, ``PAGES_TOGETHER`` at most at a time: a batch may hold 10,000 pages, and their lines as objects take many times their bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_TOGETHER):
            yield batch.slice(at, PAGES_TOGETHER).to_pylist()


LINE = pa.schema([("path", pa.string()), ("seq", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("bbox", pa.list_(pa.float64()))])


def ocr_pages(pages: DataFrame, read: Callable[[bytes], list[dict]]) -> DataFrame:
    """path, seq, text, confidence and bbox of the lines that ``read`` finds in each page's bytes (path, content, as of the binaryFile source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in few_pages(batches):
            rows = [{"path": p["path"], "seq": i, "text": x["text"], "confidence": float(x.get("confidence", 0.0)), "bbox": [float(v) for v in x.get("bbox", [])]} for p in few for i, x in enumerate(read(p["content"]))]
            yield pa.RecordBatch.from_pylist(rows, LINE)

    return pages.select("path", "content").mapInArrow(run, "path string, seq int, text string, confidence double, bbox array<double>")

"""Second readings of pages: which pages and lines are read again, and which reading is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as X
from paperloom.operators.enrich import few_pages, ocr_pages
from paperloom.operators.reconcile import better_reading, page_quality
from paperloom.sources.staging import staged

#: Fixed value: confidence below which a line is read again, as are lines with words joined.
LOW_CONFIDENCE = 0.90
#: Share of the page's height and width around a line in which a second reading's lines may lie; bands of a page that boxes meet in.
PADDING, BANDS = 0.003, 64
KEYS = ["doc_id", "page_number"]


def _joined(value: str, sep: str = " ") -> Column:
    """Aggregate: the trimmed texts in order of seq, blank ones left out."""
    return F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim(F.coalesce(value, F.lit(""))).alias("t")))), lambda s: s["t"]), lambda t: t != ""), sep)


def in_page(lines: DataFrame) -> DataFrame:
    """``lines`` with the normalized_bbox that their bbox has on the page itself: it was found on an image of the page (width, height), turned by ``turns`` quarters and enlarged by ``scale``.

    Null where there is no box, or no size. Write the result down before it is paired: the box is a long expression, which a plan repeats.
    """
    found = lines.withColumn("normalized_bbox", G.box_of("bbox"))  # a column at each step, as boxes inside boxes make expressions grow
    turned = found.withColumn("normalized_bbox", G.turned_back("normalized_bbox", "turns", F.col("width").cast("double"), F.col("height").cast("double"), "scale"))
    return turned.withColumn("normalized_bbox", G.normalised("normalized_bbox", "width", "height"))


def uncertain(lines: DataFrame) -> DataFrame:
    """The lines (text, confidence) that a second reading is asked for: low or no confidence, or words joined."""
    return lines.filter((F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) < LOW_CONFIDENCE) | F.coalesce("text", F.lit("")).rlike(X.FUSED_WORD))


def pair_readings(lines: DataFrame, again: DataFrame, padding: float = PADDING) -> DataFrame:
    """doc_id, page_number, line_id, candidate and candidate_confidence: what a second reading (``again``: doc_id, page_number, seq, text, confidence, normalized_bbox) holds where the lines are.

    A line of the second reading goes to the line whose padded box holds its
    centre, the one that it shares most of its area with where several do (then
    the smaller line_id), so none counts twice. Texts are joined by blanks in
    order of seq, confidences averaged. Lines without a box, and lines that
    nothing was read again for, are left out. The join is on the page and on the
    band of the page that the centre lies in.
    """
    box = G.valid_box("normalized_bbox")
    side = lambda i, by: F.get("b", F.lit(i)) + F.lit(by)
    around = F.array(side(0, -padding), side(1, -padding), side(2, padding), side(3, padding))
    band = lambda y: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), y)) * BANDS)
    asked = lines.select(*KEYS, "line_id", box.alias("b")).filter("b is not null").select(*KEYS, "line_id", around.alias("around"))
    asked = asked.withColumn("band", F.explode(F.sequence(band(F.get("around", F.lit(1))), band(F.get("around", F.lit(3))))))
    found = again.select(*KEYS, "seq", "text", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), box.alias("c")).filter("c is not null").withColumn("band", band(G.center_y("c")))
    inside = G.center_x("c").between(F.get("around", F.lit(0)), F.get("around", F.lit(2))) & G.center_y("c").between(F.get("around", F.lit(1)), F.get("around", F.lit(3)))
    met = asked.join(found, [*KEYS, "band"]).filter(inside)
    best = F.min_by("line_id", F.struct(-G.shared_area("around", "c"), "line_id"))
    one = met.groupBy(*KEYS, "seq").agg(best.alias("line_id"), F.first("text").alias("text"), F.first("confidence").alias("confidence"))
    return one.groupBy(*KEYS, "line_id").agg(_joined("text").alias("candidate"), F.avg("confidence").alias("candidate_confidence"))


def judge_lines(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lines`` with retry_text and retry_confidence (four places) of the uncertain ones whose second reading (``pair_readings``) is better; null for all others. The first reading stays beside it."""
    asked = uncertain(lines).select(*KEYS, "line_id", F.col("text").alias("original"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("original_confidence"))
    good = better_reading(asked.join(pairs.filter("candidate <> ''"), [*KEYS, "line_id"])).filter("better")
    return lines.join(good.select(*KEYS, "line_id", F.col("candidate").alias("retry_text"), F.round("candidate_confidence", 4).alias("retry_confidence")), [*KEYS, "line_id"], "left")


def judge_pages(lines: DataFrame, again: DataFrame, quality: DataFrame, again_quality: DataFrame) -> DataFrame:
    """doc_id, page_number, reasons, original_score, candidate_score and accepted of the pages that have a reason to be read again and were.

    The page's second reading as a whole is taken where its score, its length and
    its likeness to the first allow it. Scores come from ``page_quality``.
    """
    poor = quality.filter(F.size("reasons") > 0).select(*KEYS, "reasons", F.col("quality").alias("original_confidence"))
    both = poor.join(again_quality.select(*KEYS, F.col("quality").alias("candidate_confidence")), KEYS)
    text = lambda df, name: df.groupBy(*KEYS).agg(_joined("text").alias(name))
    pairs = both.join(text(lines, "original"), KEYS).join(text(again, "candidate"), KEYS)
    judged = better_reading(pairs, page=True)
    return judged.select(*KEYS, "reasons", F.col("original_confidence").alias("original_score"), F.col("candidate_confidence").alias("candidate_score"), F.col("better").alias("accepted"))


def keep_better(lines: DataFrame, again: DataFrame, frequencies: DataFrame | None = None, least: float = 1.5, padding: float = PADDING) -> tuple[DataFrame, DataFrame]:
    """The lines to go on with (columns of both readings that are alike, retry_text, retry_confidence), and the verdict on each page that was read again.

    A page whose second reading is better as a whole goes on with that reading's
    lines. On every other page an uncertain line keeps its text and, where the
    second reading of its place is better, has that beside it. Pages of the second
    reading that the first does not have are left out. Both readings hold
    doc_id, page_number, seq, line_id, text, confidence and normalized_bbox;
    ``frequencies`` and ``least`` are those of ``page_quality``.
    """
    pages = staged(judge_pages(lines, again, page_quality(lines, frequencies, least), page_quality(again, frequencies, least)))
    taken = pages.filter("accepted").select(*KEYS)
    shared = [c for c in lines.columns if c in again.columns]
    kept, left = again.join(taken, KEYS, "left_semi"), lines.join(taken, KEYS, "left_anti")
    judged = judge_lines(left, pair_readings(uncertain(left), again, padding))
    none = [F.lit(None).cast("string").alias("retry_text"), F.lit(None).cast("double").alias("retry_confidence")]
    return judged.select(*shared, "retry_text", "retry_confidence").unionByName(kept.select(*shared, *none)), pages


Read = Callable[[bytes], list[dict]]
REGION = pa.schema([("doc_id", pa.string()), ("page_number", pa.int32()), ("line_id", pa.string()), ("candidate", pa.string()), ("candidate_confidence", pa.float64())])


def read_twice(pages: DataFrame, read: Read, finer: Read | None = None, region: Callable[[bytes, list], list[list[dict]]] | None = None, frequencies: DataFrame | None = None, least: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Lines (path, seq, text, confidence, bbox, retry_text, retry_confidence) of pages (path, content), and the verdict on each page read again.

    ``read`` and ``finer`` give a page's lines (text, confidence, bbox). ``finer``
    is asked only for pages that have a reason, and taken as a whole or not at
    all. ``region`` gets a page's content and the boxes of its uncertain lines,
    and gives the lines of each box; where it gives another number of answers the
    page's are left out. Lines without a box are not asked for. A page without
    lines has neither lines nor a verdict.
    """
    as_lines = lambda df: df.select(F.col("path").alias("doc_id"), F.lit(1).alias("page_number"), "seq", F.col("seq").cast("string").alias("line_id"), "text", "confidence", "bbox")
    lines = staged(as_lines(ocr_pages(pages, read)))
    verdicts = staged(page_quality(lines, frequencies, least))
    if finer is not None:
        poor = verdicts.filter(F.size("reasons") > 0).select(F.col("doc_id").alias("path"))
        again = staged(as_lines(ocr_pages(pages.join(poor, "path", "left_semi"), finer)))
        judged = staged(judge_pages(lines, again, verdicts, page_quality(again, frequencies, least)))
        taken = judged.filter("accepted").select(*KEYS)
        lines = lines.join(taken, KEYS, "left_anti").unionByName(again.join(taken, KEYS, "left_semi"))
    else:
        judged = verdicts.filter(F.size("reasons") > 0).select(*KEYS, "reasons", F.col("quality").alias("original_score"), F.lit(None).cast("double").alias("candidate_score"), F.lit(False).alias("accepted"))
    pairs = None
    if region is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for few in few_pages(batches):
                rows = []
                for page in few:
                    asked = page["asked"]
                    answers = list(region(page["content"], [list(a["bbox"]) for a in asked]))
                    if len(answers) != len(asked):
                        continue
                    for a, found in zip(asked, answers, strict=True):
                        texts = [t for t in (str(x["text"]).strip() for x in found) if t]
                        if texts:
                            sure = sum(float(x.get("confidence", 0.0)) for x in found) / len(found)
                            rows.append({"doc_id": page["path"], "page_number": 1, "line_id": a["line_id"], "candidate": " ".join(texts), "candidate_confidence": sure})
                yield pa.RecordBatch.from_pylist(rows, REGION)

        asked = uncertain(lines).filter(G.box_of("bbox").isNotNull()).groupBy(F.col("doc_id").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.col("seq"), "line_id", G.box_of("bbox").alias("bbox")))).alias("asked"))
        pairs = pages.select("path", "content").join(asked, "path").mapInArrow(run, "doc_id string, page_number int, line_id string, candidate string, candidate_confidence double")
    if pairs is None:
        out = lines.withColumns({"retry_text": F.lit(None).cast("string"), "retry_confidence": F.lit(None).cast("double")})
    else:
        out = judge_lines(lines, pairs)
    return out.select(F.col("doc_id").alias("path"), "seq", "text", "confidence", "bbox", "retry_text", "retry_confidence"), judged.withColumnRenamed("doc_id", "path").drop("page_number")

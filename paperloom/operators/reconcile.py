"""Evidence reconciliation: lines against tables, formulas and figures; page, table and document quality.

Every spatial join is an equi-join on document and page (and table) first.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import geometry as G
from paperloom.functions import text as X
from paperloom.operators.similarity import duplicate_header_ratio, multiset_coverage, ratio_at_least
from paperloom.sources.staging import is_small, staged

QUALITY_TOKEN = r"[A-Za-z]{3,}"


def assign_lines_to_cells(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, page_number, line_id, table_index, cell_index and score: each line goes to at most one cell of a table, the best; ties go to the larger index."""
    keys = ["doc_id", "page_number"]
    l_ = lines.select(*keys, "line_id", F.col("normalized_bbox").alias("lb"))
    c_ = cells.select(*keys, "table_index", "cell_index", F.col("normalized_bbox").alias("cb"))
    x, y = G.center_x("lb"), G.center_y("lb")
    left, top, right, bottom = (F.get(F.col("cb"), F.lit(i)) for i in range(4))
    width, height = F.greatest(F.lit(1e-9), right - left), F.greatest(F.lit(1e-9), bottom - top)
    overlap = G.overlap_ratio("lb", "cb")
    centred = x.between(left, right) & y.between(top, bottom)
    distance = F.abs(x - G.center_x("cb")) / width + F.abs(y - G.center_y("cb")) / height
    aligned = y.between(top, top + height * 0.35)
    score = overlap + F.when(centred, 0.25).otherwise(0.0) + F.when(aligned, 0.08).otherwise(0.0) - distance * 0.05
    met = l_.join(c_, keys).filter((overlap >= 0.20) | centred).withColumn("score", score)
    best = met.groupBy(*keys, "line_id", "table_index").agg(F.max(F.struct("score", "cell_index")).alias("b"))
    return best.select(*keys, "line_id", "table_index", F.col("b.cell_index").alias("cell_index"), F.round("b.score", 6).alias("score"))


def lines_over(lines: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """doc_id, line_id and element_id of lines that an element of their page covers by ``least`` or more."""
    met = lines.select("doc_id", "page_number", "line_id", F.col("normalized_bbox").alias("lb")).join(elements.select("doc_id", "page_number", "element_id", F.col("normalized_bbox").alias("eb")), ["doc_id", "page_number"])
    return met.filter(G.overlap_ratio("lb", "eb") >= least).select("doc_id", "line_id", "element_id")


def dispositions(lines: DataFrame, elements: DataFrame, table_lines: DataFrame) -> DataFrame:
    """doc_id, page_number, line_id and disposition: table_cell for lines of accepted tables, else figure_label (0.70 covered), else verified_duplicate of a formula (0.55), else prose; unresolved without text."""
    in_table = table_lines.select("doc_id", "line_id").distinct().withColumn("t", F.lit(True))
    in_figure = lines_over(lines, elements.filter("type = 'figure'"), 0.70).select("doc_id", "line_id").distinct().withColumn("f", F.lit(True))
    in_formula = lines_over(lines, elements.filter("type = 'formula'"), 0.55).select("doc_id", "line_id").distinct().withColumn("m", F.lit(True))
    keys = ["doc_id", "line_id"]
    out = lines.join(in_table, keys, "left").join(in_figure, keys, "left").join(in_formula, keys, "left")
    kind = F.when(F.col("t"), "table_cell").when(F.col("f"), "figure_label").when(F.col("m"), "verified_duplicate").when(F.trim(F.coalesce("text", F.lit(""))) != "", "prose").otherwise("unresolved")
    return out.select("doc_id", "page_number", "line_id", kind.alias("disposition"))


DISPOSITIONS = ("prose", "table_cell", "figure_label", "verified_duplicate", "user_removed", "unresolved")


def content_coverage(found: DataFrame) -> DataFrame:
    """doc_id with line counts by disposition, percent accounted for and passed or failed."""
    counts = found.groupBy("doc_id").agg(F.count("*").alias("raw_line_count"), *[F.count_if(F.col("disposition") == d).alias(f"n_{d}") for d in DISPOSITIONS])
    open_ = F.col("n_unresolved")
    return counts.withColumn("coverage_percent", F.round((F.col("raw_line_count") - open_) * 100.0 / F.col("raw_line_count"), 2)).withColumn("status", F.when(open_ == 0, "passed").otherwise("failed"))


def remove_lines(found: DataFrame, removed: DataFrame) -> DataFrame:
    """Dispositions after a user removed lines (doc_id, line_id): they count as accounted for."""
    gone = removed.select("doc_id", "line_id").distinct().withColumn("gone", F.lit(True))
    return found.join(gone, ["doc_id", "line_id"], "left").withColumn("disposition", F.when(F.col("gone"), "user_removed").otherwise(F.col("disposition"))).drop("gone")


def page_words(lines: DataFrame) -> DataFrame:
    """doc_id, page_number and token of the distinct words of each page."""
    return lines.select("doc_id", "page_number", F.explode(X.tokens("text", QUALITY_TOKEN)).alias("token")).distinct()


def page_quality(lines: DataFrame, frequencies: DataFrame | None = None, least: float = 1.5, words: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, quality and reasons. ``frequencies`` (token, zipf) tells improbable words; without it none is. ``words`` are the ``page_words``, where they are at hand."""
    keys = ["doc_id", "page_number"]
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    per = lines.groupBy(*keys).agg(F.avg(sure).alias("mean"), F.avg((sure < 0.90).cast("int")).alias("low"), F.avg(F.coalesce("text", F.lit("")).rlike(X.FUSED_WORD).cast("int")).alias("fused"))
    if frequencies is None:
        per = per.withColumn("odd", F.lit(0.0))
    else:
        words = (words or page_words(lines)).join(frequencies.select("token", "zipf"), "token", "left")
        per = per.join(words.groupBy(*keys).agg(F.avg((F.coalesce("zipf", F.lit(0.0)) < least).cast("int")).alias("odd")), keys, "left").withColumn("odd", F.coalesce("odd", F.lit(0.0)))
    score = F.col("mean") * 0.58 + (1 - F.col("low")) * 0.17 + (1 - F.col("odd")) * 0.15 + (1 - F.col("fused")) * 0.10
    reasons = F.array_compact(F.array(F.when(F.col("low") >= 0.12, "low_confidence_density"), F.when(F.col("odd") >= 0.12, "improbable_token_density"), F.when(F.col("fused") >= 0.04, "fused_word_density")))
    return per.select(*keys, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("quality"), reasons.alias("reasons"))


def document_quality(lines: DataFrame, tables: DataFrame, coverage: DataFrame, reviews: DataFrame, threshold: float = 0.90) -> DataFrame:
    """doc_id, counts of low-confidence lines, improbable words, unverified tables and unaccounted lines, and good or needs_review."""
    per = lines.groupBy("doc_id").agg(F.count_if(F.coalesce(F.col("confidence"), F.lit(0.0)) < threshold).alias("low_confidence_count"))
    more = (
        tables.groupBy("doc_id").agg(F.count_if(F.col("status") != "accepted").alias("unverified_table_count")),
        coverage.select("doc_id", F.col("n_unresolved").alias("unaccounted_line_count")),
        reviews.groupBy("doc_id").agg(F.count_if(F.col("kind").isin("word_boundary", "spelling")).alias("improbable_token_count"), F.count("*").alias("review_count")),
    )
    for m in more:
        per = per.join(m, "doc_id", "left")
    per = per.fillna(0)
    bad = F.col("low_confidence_count") + F.col("unverified_table_count") + F.col("unaccounted_line_count") + F.col("review_count")
    return per.withColumn("status", F.when(bad > 0, "needs_review").otherwise("good"))


def table_geometry(cells: DataFrame) -> DataFrame:
    """doc_id, table_index and geometry score of cells (row, col, row_span, col_span, text, normalized_bbox, geometry_normalized)."""
    keys = ["doc_id", "table_index"]
    wrong = (F.col("row") < 0) | (F.col("col") < 0) | (F.col("row_span") < 1) | (F.col("col_span") < 1)
    per = cells.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((F.trim(F.coalesce("text", F.lit(""))) == "").cast("int")).alias("blank"), F.avg(F.col("normalized_bbox").isNotNull().cast("int")).alias("boxed"),
        F.bool_or("geometry_normalized").alias("normal"), F.bool_or((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("spans"), F.bool_or(wrong).alias("wrong"),
    )
    covered = cells.filter(~wrong).select(*keys, F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r"), "col", "col_span")
    covered = covered.select(*keys, "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c"))
    twice = covered.groupBy(*keys, "r", "c").count().filter("count > 1").select(*keys).distinct().withColumn("twice", F.lit(True))
    bare = (F.col("boxed") == 1.0) & (F.col("n") > 1) & ~F.col("spans") & ~F.col("normal")
    score = F.lit(0.65) + F.col("boxed") * 0.25 + F.when(F.col("normal"), 0.1).otherwise(0.0) - F.col("blank") * 0.5 - F.when(bare, 0.2).otherwise(0.0) - F.when(F.col("wrong") | F.coalesce("twice", F.lit(False)), 0.35).otherwise(0.0)
    return per.join(twice, keys, "left").select(*keys, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("geometry_score"))


#: What a table's components weigh.
GEOMETRY_WEIGHT = 0.20
TABLE_WEIGHTS = {"source_coverage": 0.25, "text_agreement": 0.15, "table_token_coverage": 0.10, "orientation": 0.10, "bbox_identity": 0.10, "plausibility": 0.05, "cell_html_correspondence": 0.05}


def table_quality(geometry: Column, components: dict[str, Column] | None = None) -> Column:
    """The geometry score, or with components the weighted blend of eight terms, four places."""
    if components is None:
        return geometry
    total = geometry * GEOMETRY_WEIGHT
    for name, weight in TABLE_WEIGHTS.items():
        default = 1.0 if name == "cell_html_correspondence" else 0.0
        total = total + F.coalesce(components.get(name, F.lit(default)), F.lit(default)) * weight
    return F.round(total, 4)


def verify_tables(tables: DataFrame, cells: DataFrame, lines: DataFrame, least_quality: float = 0.85, least_coverage: float = 0.90) -> DataFrame:
    """doc_id, table_index, quality_score, status and components of tables (bbox_identity_score) whose cells are held against recognised lines.

    A cell whose lines are read surely (0.90) takes their text; an empty one from
    0.85. Accepted: a source line, quality, coverage of the source's words, and
    box identity of 0.25.
    """
    keys = ["doc_id", "table_index"]
    at = assign_lines_to_cells(lines, cells).join(lines.select("doc_id", "line_id", "seq", "text", "confidence"), ["doc_id", "line_id"])
    source = at.groupBy(*keys, "cell_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("source_text"), F.avg("confidence").alias("source_confidence")
    )
    met = cells.select(*keys, "cell_index", F.trim(F.coalesce("text", F.lit(""))).alias("own")).join(source, [*keys, "cell_index"], "left")
    both = (F.coalesce("source_text", F.lit("")) != "") & (F.col("own") != "")
    sure = F.col("source_confidence") >= F.when(F.col("own") != "", 0.90).otherwise(0.85)
    met = met.withColumn("text", F.when((F.coalesce("source_text", F.lit("")) != "") & sure, F.col("source_text")).otherwise(F.col("own"))).withColumn("both", both)
    bare = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\W+", ""))
    agreed = duplicate_header_ratio(met.filter("both").select(*keys, bare("own").alias("a"), bare("source_text").alias("b")), "a", "b").groupBy(*keys).agg(F.avg("ratio").alias("agreement"))
    whole = lambda df, order: df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), " ").alias("text"))
    cell_words, line_words = whole(met, "cell_index"), whole(at, "seq")
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    plausible = cell_words.select(*keys, F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.rlike(r"(?U)\w"))) / F.size(words)).otherwise(0.0).alias("plausibility"))
    everything = tables.select(*keys, F.coalesce("bbox_identity_score", F.lit(0.0)).alias("identity"), "geometry_normalized")
    out = everything.join(multiset_coverage(line_words, cell_words, keys).withColumnRenamed("coverage", "source_coverage"), keys, "left").join(multiset_coverage(cell_words, line_words, keys).withColumnRenamed("coverage", "table_token_coverage"), keys, "left")
    out = out.join(agreed, keys, "left").join(plausible, keys, "left").join(table_geometry(cells), keys, "left").join(line_words.select(*keys, F.lit(True).alias("has_lines")), keys, "left")
    coverage = F.coalesce("source_coverage", F.lit(1.0))
    identity = F.when(F.col("has_lines").isNull(), F.least("identity", F.lit(0.5))).otherwise(F.col("identity"))
    parts = {
        "source_coverage": F.round(coverage, 4), "table_token_coverage": F.round(F.coalesce("table_token_coverage", F.lit(0.0)), 4), "text_agreement": F.round(F.coalesce(F.col("agreement"), coverage), 4),
        "orientation": F.when(F.col("geometry_normalized"), 1.0).otherwise(0.5), "bbox_identity": F.round(identity, 4), "plausibility": F.round(F.coalesce("plausibility", F.lit(0.0)), 4),
    }
    out = out.withColumns({"quality_score": table_quality(F.coalesce("geometry_score", F.lit(0.0)), parts), **{f"c_{k}": v for k, v in parts.items()}})
    fine = F.coalesce("has_lines", F.lit(False)) & (F.col("quality_score") >= least_quality) & (coverage >= least_coverage) & (identity >= 0.25)
    return out.withColumn("status", F.when(fine, "accepted").otherwise("needs_review")).select(*keys, "quality_score", "status", *[F.col(f"c_{k}").alias(k) for k in parts])


def match_tables_to_blocks(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, table_index, block_index and score: tables take, in order, the block of best overlap that none has; a single pair without any matches by 0.5.

    A page holds tens of them: they are collected on its row, and taken one after the other there.
    """
    keys = ["doc_id", "page_number"]
    t = tables.select(*keys, F.col("table_index").cast("int").alias("table_index"), F.col("normalized_bbox").alias("tb"))
    b = blocks.select(*keys, F.col("block_index").cast("int").alias("block_index"), F.col("normalized_bbox").alias("bb"))
    on_page = b.groupBy(*keys).agg(F.count("*").alias("nb"), F.collect_list(F.when(F.col("block_index").isNotNull(), F.struct("block_index", "bb"))).alias("blocks"))
    met = t.groupBy(*keys).agg(F.count("*").alias("nt"), F.collect_list(F.struct("table_index", "tb")).alias("tables")).join(on_page, keys, "left")
    met = met.withColumn("nb", F.coalesce("nb", F.lit(0))).select(*keys, "nt", "nb", F.explode("tables").alias("t"), "blocks").select(*keys, "nt", "nb", "t.*", F.explode_outer("blocks").alias("b"))
    met = met.select(*keys, "nt", "nb", "table_index", F.col("b.block_index").alias("block_index"), G.iou("tb", "b.bb").alias("iou"))
    # the best first, unknown overlaps last
    option = F.when(F.col("block_index").isNotNull(), F.struct((-F.coalesce("iou", F.lit(float("-inf")))).alias("less"), "block_index"))
    each = met.groupBy(*keys, "table_index").agg(F.array_sort(F.collect_list(option)).alias("options"), F.first("nt").alias("nt"), F.first("nb").alias("nb"))
    pages = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("table_index", "options"))).alias("tables"), (F.first("nt") == 1).alias("one"), (F.first("nb") == 1).alias("single"))

    def take(taken: Column, table: Column) -> Column:
        free = F.get(F.filter(table["options"], lambda o: ~F.exists(taken, lambda r: F.coalesce(r["block_index"] == o["block_index"], F.lit(False)))), F.lit(0))

        def row(o: Column) -> Column:
            meets, alone = F.coalesce(o["less"] < 0, F.lit(False)), o.isNotNull() & F.col("one") & F.col("single")
            return F.struct(table["table_index"].alias("table_index"), F.when(meets | alone, o["block_index"]).alias("block_index"), F.when(meets, -o["less"]).when(alone, 0.5).otherwise(0.0).alias("score"))

        return F.concat(taken, F.transform(F.array(free), row))

    none = F.array().cast("array<struct<table_index:int,block_index:int,score:double>>")
    return pages.select(*keys, F.explode(F.aggregate("tables", none, take)).alias("m")).select(*keys, "m.*")


def attach_margin_marks(lines: DataFrame) -> DataFrame:
    """doc_id, page_number, mark_line_id, line_id and mark: a number of one or two digits in the right margin belongs to the nearest line within 0.025 of its height."""
    box = F.col("normalized_bbox")
    is_mark = F.trim("text").rlike(r"^\d{1,2}$") & (F.get(box, F.lit(0)) >= 0.80) & (F.get(box, F.lit(3)) <= 0.95)
    marks = lines.filter(is_mark).select("doc_id", "page_number", F.col("line_id").alias("mark_line_id"), F.lpad(F.trim("text"), 2, "0").alias("mark"), G.center_y("normalized_bbox").alias("my"))
    rest = lines.filter(~F.coalesce(is_mark, F.lit(False)) & box.isNotNull()).select("doc_id", "page_number", "line_id", "seq", G.center_y("normalized_bbox").alias("y"))
    near = marks.join(rest, ["doc_id", "page_number"]).withColumn("far", F.abs(F.col("y") - F.col("my"))).filter("far <= 0.025")
    return near.groupBy("doc_id", "page_number", "mark_line_id", "mark").agg(F.min_by("line_id", F.struct("far", "seq")).alias("line_id"))


def caption_context(anchors: DataFrame, blocks: DataFrame, most: int = 180) -> DataFrame:
    """doc_id, element_id and caption: of the page's blocks above the figure's centre, the last in sequence."""
    a = anchors.select("doc_id", "page_number", "element_id", G.center_y("normalized_bbox").alias("ay"))
    b = blocks.select("doc_id", "page_number", "seq", "text", G.center_y("normalized_bbox").alias("y"))
    return a.join(b, ["doc_id", "page_number"]).filter("y < ay").groupBy("doc_id", "element_id").agg(F.substring(F.max_by("text", "seq"), 1, most).alias("caption"))


def merge_anchors(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Blocks and anchors of each page in reading order: an anchor comes before the first block whose centre is lower."""
    b = blocks.select("doc_id", "page_number", "seq", F.lit(None).cast("string").alias("element_id"), "line_id", G.center_y("normalized_bbox").alias("y"))
    a = anchors.select("doc_id", "page_number", "element_id", G.center_y("normalized_bbox").alias("ay"))
    first = a.join(b.select("doc_id", "page_number", "seq", "y"), ["doc_id", "page_number"], "left").groupBy("doc_id", "page_number", "element_id", "ay").agg(F.min(F.when(F.col("y") > F.col("ay"), F.col("seq"))).alias("before"))
    placed = first.select("doc_id", "page_number", F.coalesce(F.col("before").cast("double") - 0.5, F.lit(1e18)).alias("at"), F.lit(0).alias("kind"), "element_id", F.lit(None).cast("string").alias("line_id"), "ay")
    lines = b.select("doc_id", "page_number", F.col("seq").cast("double").alias("at"), F.lit(1).alias("kind"), "element_id", "line_id", F.col("y").alias("ay"))
    order = Window.partitionBy("doc_id", "page_number").orderBy("at", "kind", "ay", "element_id")
    return placed.union(lines).withColumn("place", F.row_number().over(order)).select("doc_id", "page_number", "place", "element_id", "line_id")


def suppress_adjacent_duplicates(elements: DataFrame) -> DataFrame:
    """Elements (doc_id, page_number, seq, content, normalized_bbox) without those that repeat, or all but repeat, the last kept one at the same place; the longer text stays.

    A fold over each page's elements in order.
    """
    items = elements.select("doc_id", "page_number", F.struct("seq", "content", "normalized_bbox").alias("item"))
    pages = items.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list("item")).alias("items"))

    def step(kept: Column, item: Column) -> Column:
        prior = F.try_element_at(kept, F.lit(-1))
        new, old = X.clean(item["content"]), X.clean(prior["content"])
        a, b = X.fold(new), X.fold(old)
        short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
        alike = (a == b) | ((short >= 12) & (F.startswith(a, b) | F.startswith(b, a)) & (short / long >= 0.9))
        again = (F.size(kept) > 0) & (new != "") & alike & (G.iou(prior["normalized_bbox"], item["normalized_bbox"]) >= 0.85)
        swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(item))
        return F.when(F.coalesce(again, F.lit(False)), F.when(F.length(new) > F.length(old), swapped).otherwise(kept)).otherwise(F.concat(kept, F.array(item)))

    kept = F.aggregate("items", F.slice("items", 1, 0), step)
    return pages.select("doc_id", "page_number", F.explode(kept).alias("e")).select("doc_id", "page_number", "e.*")


def clean_integer_rows(cells: DataFrame) -> DataFrame:
    """Cells without the speck before a whole number, in rows of three or more whole-number cells."""
    t = F.trim("text")
    n = F.count_if(t.rlike(r"^[.·。]?\d{2,}$")).over(Window.partitionBy("doc_id", "table_index", "row"))
    return cells.withColumn("text", F.when((n >= 3) & t.rlike(r"^[.·。]\d{2,}$"), F.regexp_replace(t, r"^[.·。]", "")).otherwise(F.col("text")))


def better_reading(pairs: DataFrame, page: bool = False) -> DataFrame:
    """Pairs (original, candidate, confidences; of a page, scores) and whether the second reading is better.

    A line: blanks restored at no less confidence, or 0.08 more confidence and a
    ratio of 0.72. A page: 0.025 more score, a ratio of 0.55 and 85 % of the length.
    """
    bare = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\W+", ""))
    rows = pairs.withColumn("ka", bare("original")).withColumn("kb", bare("candidate"))
    filled = (F.col("ka") != "") & (F.col("kb") != "")
    gain = F.col("candidate_confidence") - F.col("original_confidence")
    enough = (gain >= 0.025) & (F.length("kb") >= F.floor(F.length("ka") * 0.85)) if page else gain >= 0.08
    # only a gain makes the ratio matter, and equal texts have 1
    rows = rows.withColumn("apart", filled & enough & (F.col("ka") != F.col("kb"))).withColumns({"xa": F.when(F.col("apart"), F.col("ka")), "xb": F.when(F.col("apart"), F.col("kb"))})
    rows = rows.withColumn("alike", ratio_at_least("xa", "xb", 0.55 if page else 0.72)).drop("apart", "xa", "xb")
    if page:
        good = enough & F.col("alike")
    else:
        blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
        restored = (F.col("ka") == F.col("kb")) & (blanks("candidate") > blanks("original")) & F.col("original").rlike(X.FUSED_WORD)
        good = (restored & (gain >= 0)) | (enough & F.col("alike"))
    return rows.withColumn("better", F.coalesce(filled & good, F.lit(False))).drop("ka", "kb", "alike")


TAGS = re.compile(r"""(?is)<!--.*?-->|<(/?)(table|tr|td|th)\b((?:"[^"]*"|'[^']*'|[^'">])*)>|<[^>]*>""")
SPAN = r"""(?is)(?:^|\s){}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
SPANS = {name: re.compile(SPAN.format(name)) for name in ("rowspan", "colspan")}

#: Cells one after the other without attributes and without tags or comments in or between them, and one of them.
PLAIN_CELLS = re.compile(r"(?i)[^<]*+(?:<(?:td>[^<]*+</td|th>[^<]*+</th)>[^<]*+)++")
PLAIN_CELL = re.compile(r"(?i)<t[dh]>([^<]*+)<")


def _span(attributes: str, name: str) -> int | None:
    """A cell's span; none where it is no whole number from 1 on."""
    found = SPANS[name].search(attributes)
    value = next((g for g in found.groups() if g is not None), "") if found else ""
    value = value.strip() or "1"
    return int(value) if re.fullmatch(r"\+?[0-9]{1,18}", value) and int(value) else None


def table_cells(html: str | None, most: int) -> list[tuple]:
    """(table_index, row, col, row_span, col_span, text, error) of the cells of an HTML text's tables.

    The tags are read in order, the open table and cell are kept. A table has one
    row with an error in place of its cells where a cell stands outside a row,
    begins or ends a table inside another cell, or is not closed (malformed),
    where a span is no whole number from 1 on (span), or where spans overlap
    (overlap). A text whose cells cover more than ``most`` places has one such row.
    Plain cells below which no other reaches are taken together.
    """
    out: list[tuple] = []
    index, depth, covered = -1, 0, 0
    cells: list[tuple] = []
    taken: set[tuple[int, int]] = set()
    error = cell = None
    row, col, at, reach = -1, 0, 0, -1  # reach: the last row that a span covers
    text: list[str] = []
    html, begin = html or "", 0

    def close() -> None:
        wrong = error or ("malformed" if cell else None)
        out.extend([(index, None, None, None, None, None, wrong)] if wrong else [(index, *c, None) for c in cells])

    while m := TAGS.search(html, begin):
        begin = m.end()
        if cell:
            text.append(html[at : m.start()])
        at = m.end()
        closing, tag, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if tag == "table" and not closing:
            depth += 1
            if depth == 1:
                index, cells, taken, error, cell, row, col, reach = index + 1, [], set(), None, None, -1, 0, -1
            else:
                error = error or "malformed"
        elif not depth or not tag:
            continue
        elif tag == "table":
            depth -= 1
            if not depth:
                close()
        elif depth > 1 or error:
            continue
        elif tag == "tr":
            if not closing:
                row, col = row + 1, 0
                if not cell and reach < row and (run := PLAIN_CELLS.match(html, begin)):
                    found = PLAIN_CELL.findall(run[0])
                    covered += len(found)
                    if covered > most:
                        return [(None, None, None, None, None, None, "too_many_cells")]
                    cells += [(row, c, 1, 1, " ".join((entities.unescape(t) if "&" in t else t).split())) for c, t in enumerate(found)]
                    col, begin = len(found), run.end()
        elif not closing:
            spans = [_span(attributes, name) for name in SPANS]
            if row < 0 or cell:
                error = "malformed"
            elif None in spans:
                error = "span"
            else:
                while (row, col) in taken:
                    col += 1
                cell, text = (row, col, *spans), []
                covered += spans[0] * spans[1]
                if covered > most:
                    return [(None, None, None, None, None, None, "too_many_cells")]
        elif cell:
            spots = {(r, c) for r in range(row, row + cell[2]) for c in range(col, col + cell[3])} if cell[0] == row else {(-1, -1)}
            if cell[0] != row or spots & taken:
                error = "malformed" if cell[0] != row else "overlap"
            taken |= spots
            reach = max(reach, cell[0] + cell[2] - 1)
            cells.append((*cell, " ".join(entities.unescape(" ".join(text)).split())))
            col, cell = col + cell[3], None
    if depth:
        close()
    return out


CELL = "table_index int, row int, col int, row_span int, col_span int, text string, error string"
#: Cells of a batch of rows that go on together.
CELLS_TOGETHER = 50_000


def extract_cells(pages: DataFrame, most: int = 100_000) -> DataFrame:
    """page_id, table_index, row, col, row_span, col_span, text and error of the tables in ``html`` (see ``table_cells``); a null or a text without tables has no rows.

    Scripts, styles and images go first, natively; a page's tags are then read in
    one ordered pass, in Arrow batches.
    """
    page_id = pages.schema["page_id"]
    schema = T.StructType([page_id, *T.StructType.fromDDL(CELL).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(),) * 5 + (pa.string(),) * 2
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], names=schema.names)

        for batch in batches:
            of: list[int] = []
            rows: list[tuple] = []
            for i, html in enumerate(batch.column(1)):
                found = table_cells(html.as_py(), most)
                of += [i] * len(found)
                rows += found
                if len(rows) >= CELLS_TOGETHER:
                    yield made(batch, of, rows)
                    of, rows = [], []
            if rows:
                yield made(batch, of, rows)

    # a row of its own, so that the filter does not make the text once more
    return pages.select("page_id", F.explode(F.array(X.sanitise_html("html"))).alias("html")).filter(F.contains(F.lower("html"), F.lit("<table"))).mapInArrow(run, schema)


@F.udtf(returnType="table_index int, row int, col int, row_span int, col_span int, text string")
class html_cells:
    """Table function: the cells of an HTML text's tables that have no error, for lateral joins."""

    def eval(self, html: str):
        for *cell, error in table_cells(html, 100_000):
            if error is None:
                yield tuple(cell)


def cell_grid(cells: DataFrame) -> DataFrame:
    """page_id, table_index, row and Markdown of each row of a table; positions that a span covers are empty."""
    keys = ["page_id", "table_index"]
    wide = cells.filter("error is null").groupBy(*keys).agg(F.max(F.col("row") + F.col("row_span")).alias("rows"), F.max(F.col("col") + F.col("col_span")).alias("cols"))
    spots = wide.select(*keys, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols").select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"\s*\n\s*", "<br>"), r"\|", r"\\|"))
    filled = spots.join(cells.filter("error is null").select(*keys, "row", "col", text.alias("t")), [*keys, "row", "col"], "left")
    return filled.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("t", F.lit("")).alias("t")))).alias("c")).select(*keys, "row", F.concat(F.lit("| "), F.array_join(F.transform("c", lambda s: s["t"]), " | "), F.lit(" |")).alias("markdown"))


def cell_html(cells: DataFrame) -> DataFrame:
    """page_id, table_index and HTML of each table, spans as attributes; cells in the first row are headings."""
    keys = ["page_id", "table_index"]
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    text = F.trim(F.coalesce("text", F.lit("")))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    cell = F.concat(F.lit("    <"), tag, span("rowspan", "row_span"), span("colspan", "col_span"), F.lit(">"), text, F.lit("</"), tag, F.lit(">"))
    in_order = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), "\n")
    rows = cells.filter("error is null").select(*keys, "row", "col", cell.alias("cell")).groupBy(*keys, "row").agg(F.concat(F.lit("  <tr>\n"), in_order("col", "cell"), F.lit("\n  </tr>")).alias("tr"))
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>\n"), in_order("row", "tr"), F.lit("\n</table>")).alias("html"))


def correct_spelling(tokens: DataFrame, unigrams: DataFrame, least: int = 5000, dominance: float = 10.0) -> DataFrame:
    """token and corrected of distinct words (token) one edit from a known word (word, n): frequent, ten times the next candidate and the word itself.

    A delete-neighbourhood join: words that one edit parts share a deletion, so no
    word meets the whole dictionary.
    """
    def reduced(df: DataFrame, word: str, *more: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, F.length(word))))
        return df.select(word, *more, F.explode(F.array_distinct(F.concat(F.array(F.col(word)), cut))).alias("key"))

    own = tokens.select("token").distinct().filter(F.length("token") >= 4).join(unigrams.select(F.col("word").alias("token"), F.col("n").alias("own_n")), "token", "left")
    met = reduced(own.filter(F.coalesce("own_n", F.lit(0)) < least), "token", "own_n").join(reduced(unigrams.filter(F.col("n") >= least), "word", "n"), "key").select("token", "own_n", "word", "n").distinct()
    near = met.filter((F.col("token") != F.col("word")) & (F.levenshtein("token", "word") <= 1))
    order = Window.partitionBy("token").orderBy(F.desc("n"), "word")
    best = near.withColumn("next_n", F.coalesce(F.lead("n").over(order), F.lit(0))).withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.filter((F.col("n") >= F.col("next_n") * dominance) & (F.col("n") >= F.coalesce("own_n", F.lit(0)) * dominance)).select("token", F.col("word").alias("corrected"))


#: Short words that a joined word may hold.
SHORT_WORDS = ("a", "i", "of", "to", "in", "on", "at", "by", "or", "as", "is", "it", "an", "be")
#: Letters of a token that may be words joined, of one of its words at most, and words in it at most.
JOINED, LONGEST_WORD, MOST_JOINED = 12, 24, 5
#: Frequencies (logarithm to base ten, of a billion words): a word that parts may be, a token that is none; and how far the best parting has to be ahead of the next.
WORD_LEVEL, UNKNOWN_LEVEL, AHEAD = 3.0, 1.5, 2.5


def _asked_of(counts: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``counts`` that ``asked`` names, as a table; a small ``asked`` is sent to every task, where Spark drops the others before it counts."""
    named = staged(asked.select(*keys).distinct())
    return staged(counts.join(F.broadcast(named) if is_small(named) else named, keys, "left_semi"))


def split_joined(tokens: DataFrame, unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """token, suggested, score and taken of distinct tokens (token) that words joined: the best parting into two to five known words (``unigrams``: word, n) each two of which are known to stand together (``bigrams``: first, second, n).

    A parting's score adds its words' levels and, for each two, a quarter of
    log(1 + n). It is taken where no other comes within ``AHEAD`` of it, else it
    is for a reviewer. Partings grow word by word through joins; of those that
    end with the same word at the same place, the best two go on, as what may
    follow depends on nothing else.
    """
    unigrams = staged(unigrams)
    total = float(unigrams.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0])
    level = lambda n: F.log10(n) + 9 - F.lit(math.log10(total))
    known = unigrams.select("word", level(F.col("n")).alias("level"))
    own = tokens.select("token").distinct().filter(F.col("token").rlike(rf"^[a-z]{{{JOINED},}}$")).join(known.select(F.col("word").alias("token"), F.col("level").alias("own_level")), "token", "left")
    asked = staged(own.filter(F.coalesce("own_level", F.lit(0.0)) < UNKNOWN_LEVEL).select("token"))
    begins = asked.select("token", F.explode(F.sequence(F.lit(0), F.length("token") - 1)).alias("a"))
    spots = begins.select("token", "a", F.explode(F.sequence(F.col("a") + 1, F.least(F.length("token"), F.col("a") + LONGEST_WORD))).alias("b"))
    spots = spots.withColumn("word", F.col("token").substr(F.col("a") + 1, F.col("b") - F.col("a")))
    short = F.col("word").isin(*SHORT_WORDS)
    parts = staged(spots.filter((F.length("word") >= 3) | short).join(known, "word").filter(short | (F.col("level") >= WORD_LEVEL)))
    after = parts.select("token", F.col("a").alias("b"), F.col("b").alias("c"), F.col("word").alias("second"), F.col("level").alias("second_level"))
    meets = staged(parts.select("token", "a", "b", F.col("word").alias("first")).join(after, ["token", "b"]))
    links = meets.join(_asked_of(bigrams.select("first", "second", "n"), meets, ["first", "second"]).filter("n > 0"), ["first", "second"])
    links = staged(links.select("token", "a", "b", "c", "second", (F.col("second_level") + F.log1p("n") / 4).alias("more")))
    paths = parts.filter("a = 0").select("token", "a", "b", F.col("level").alias("score"), F.col("word").alias("suggested"))
    whole = []
    for _ in range(MOST_JOINED - 1):
        longer = paths.join(links, ["token", "a", "b"]).select("token", F.col("b").alias("a"), F.col("c").alias("b"), (F.col("score") + F.col("more")).alias("score"), F.concat_ws(" ", "suggested", "second").alias("suggested"))
        best = Window.partitionBy("token", "a", "b").orderBy(F.desc("score"), "suggested")
        paths = longer.withColumn("r", F.row_number().over(best)).filter("r <= 2").drop("r")
        whole.append(paths.filter(F.col("b") == F.length("token")).select("token", "score", "suggested"))
    found = whole[0]
    for more in whole[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("token").orderBy(F.desc("score"), "suggested")
    first = found.withColumn("next", F.lead("score").over(order)).withColumn("r", F.row_number().over(order)).filter("r = 1")
    return first.select("token", "suggested", "score", (F.col("next").isNull() | (F.col("score") >= F.col("next") + AHEAD)).alias("taken"))


#: A line's words, with inner apostrophes and hyphens, and what lies between them.
PIECES = r"[A-Za-z]+(?:['-][A-Za-z]+)*|[^A-Za-z]+"
#: Fixed value: the words before which an expression with an equals sign ends.
EXPRESSION = r"(?i)^(.*?)((?:[A-Za-z][A-Za-z0-9_]*\s*)?=.*?)(?=\s+(?:at|where|when|for|and|or|but|with|from|on)\s+[A-Za-z]|$)"
#: A correction's neighbours must speak for it by this factor where they speak for the word as it stands.
CONTEXT_GAIN = 3.0


def _pieces(text: Column) -> Column:
    """A line's pieces; an expression, from the name before its equals sign (else from the line's start) on, is one."""
    whole, before = F.regexp_extract(text, EXPRESSION, 0), F.regexp_extract(text, EXPRESSION, 1)
    named = F.regexp_extract(text, EXPRESSION, 2).rlike("^[A-Za-z]")
    start = F.when(named, F.length(before)).otherwise(0)
    cut = lambda c: F.regexp_extract_all(c, F.lit(PIECES), F.lit(0))
    parted = F.concat(cut(F.substring(text, F.lit(1), start)), F.array(F.substring(text, start + 1, F.length(whole) - start)), cut(F.substring(text, F.length(whole) + 1, F.length(text))))
    return F.when(F.contains(text, F.lit("=")), parted).otherwise(cut(text))


def correct_lines(lines: DataFrame, spelling: DataFrame, bigrams: DataFrame, joined: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Corrected lines (doc_id, line_id, original, text, confidence), and the corrections that are left to a reviewer (doc_id, line_id, place, token, suggested).

    ``spelling`` (token, corrected) proposes for words in lower case; ``bigrams``
    (first, second, n) tell how often two words stand together. Where a word's
    neighbours already speak for it, the proposal has to be three times as likely
    beside them (in the sum of logarithms), or it is only a review. ``joined``
    (see ``split_joined``) parts words that were joined, or proposes it. The
    expression around an equals sign stays as it is.
    """
    cut = lines.select("doc_id", "line_id", F.col("text").alias("original"), _pieces(F.col("text")).alias("pieces"))
    each = cut.select("doc_id", "line_id", "pieces", F.posexplode("pieces").alias("place", "token"))
    is_word = lambda w: w.rlike("^[A-Za-z]")
    earlier = lambda i: F.filter(F.slice("pieces", F.lit(1), i), is_word)
    found = each.join(spelling.select("token", "corrected"), "token")
    later = F.filter(F.slice("pieces", F.col("place") + 2, F.size("pieces")), is_word)
    found = found.withColumn("before", F.lower(F.try_element_at(earlier(F.col("place")), F.lit(-1)))).withColumn("after", F.lower(F.get(later, F.lit(0)))).drop("pieces")
    found = staged(found)
    beside = (("s1", "before", "token"), ("s2", "token", "after"), ("c1", "before", "corrected"), ("c2", "corrected", "after"))
    asked = found.select(F.explode(F.array(*[F.struct(F.col(a).alias("first"), F.col(b).alias("second")) for _, a, b in beside])).alias("p")).select("p.first", "p.second")
    told = _asked_of(bigrams.select("first", "second", "n"), asked.dropna(), ["first", "second"])
    for name, first, second in beside:
        known = told.select(F.col("first").alias(first), F.col("second").alias(second), F.log1p("n").alias(name))
        found = found.join(known, [first, second], "left")
    stands = F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))
    speaks = F.coalesce("c1", F.lit(0.0)) + F.coalesce("c2", F.lit(0.0))
    better = speaks > stands + F.log(F.lit(CONTEXT_GAIN))
    judged = found.select("doc_id", "line_id", "place", "token", "corrected", F.when(better, 0.95).otherwise(0.9).alias("sure"), ((stands == 0) | better).alias("taken"))
    if joined is not None:
        parted = each.join(joined.select("token", F.col("suggested").alias("corrected"), "taken"), "token").select("doc_id", "line_id", "place", "token", "corrected", F.lit(0.97).alias("sure"), "taken")
        # a token is parted or respelled, not both
        judged = judged.join(parted.filter("taken").select("doc_id", "line_id", "place"), ["doc_id", "line_id", "place"], "left_anti").unionByName(parted)
    taken = judged.filter("taken").groupBy("doc_id", "line_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "corrected"))).alias("new"), F.min("sure").alias("confidence"))
    text = F.array_join(F.transform("pieces", lambda w, i: F.coalesce(F.try_element_at("new", i), w)), "")
    corrected = cut.join(taken, ["doc_id", "line_id"]).select("doc_id", "line_id", "original", text.alias("text"), "confidence")
    return corrected, judged.filter("not taken").select("doc_id", "line_id", "place", "token", F.col("corrected").alias("suggested"))


def reject_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements of layout blocks (type, bbox, content: an array joined by blanks), and the malformed ones."""
    box = G.box_of("bbox")
    good = F.col("type").isNotNull() & box.isNotNull() & F.col("content").isNotNull()
    return blocks.filter(good).withColumn("bbox", box).withColumn("content", F.array_join("content", " ")), blocks.filter(~F.coalesce(good, F.lit(False)))


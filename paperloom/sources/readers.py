"""Readers: results, predictions, taxonomies, syllabi, curricula, manifests, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as X
from paperloom.sources import schemas


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, lines, elements, tables, cells and errors of a folder of result files (JSON documents); one that cannot be read is an error row."""
    rows = spark.read.schema(schemas.RESULT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("path", F.input_file_name())
    bad = F.col("_corrupt_record").isNotNull() | F.col("job_id").isNull()
    good = rows.filter(~bad)
    lines = good.select("job_id", F.posexplode("lines").alias("seq", "l")).select("job_id", "seq", "l.*")
    lines = lines.withColumn("page_number", F.coalesce("page_number", F.col("page_index") + 1)).withColumn("line_id", F.coalesce("line_id", F.concat(F.lit("line-"), F.col("seq") + 1)))
    tables = good.select("job_id", F.explode("tables").alias("t")).select("job_id", "t.*")
    return {
        "documents": good.select("job_id", "full_text", "language", "document_profile", "page_count"), "lines": lines,
        "elements": good.select("job_id", F.posexplode("elements").alias("seq", "e")).select("job_id", "seq", "e.*"),
        "tables": tables.drop("cells"), "cells": tables.select("job_id", "table_index", F.posexplode("cells").alias("cell_index", "c")).select("job_id", "table_index", "cell_index", "c.*"),
        "errors": rows.filter(bad).select("path", F.coalesce("_corrupt_record", F.lit("job_id is missing")).alias("record")),
    }


def lines_from_predictions(pages: DataFrame) -> DataFrame:
    """Lines of pages with parallel arrays rec_texts, rec_scores, rec_boxes and rec_polys: a missing score is 0, a missing box the polygon, else empty."""
    each = pages.select(*[c for c in pages.columns if c != "rec_texts"], F.posexplode("rec_texts").alias("i", "text"))
    box = F.coalesce(F.get("rec_boxes", F.col("i")), F.get("rec_polys", F.col("i")), F.array().cast("array<double>"))
    page = F.col("page_index") + 1
    return each.select(
        "doc_id", F.col("i").alias("seq"), "page_index", page.alias("page_number"), F.format_string("p%04d-l%05d", page, F.col("i") + 1).alias("line_id"), "text",
        F.round(F.coalesce(F.get("rec_scores", F.col("i")), F.lit(0.0)), 4).alias("confidence"), box.alias("bbox"),
        *([G.normalised(box, "width", "height").alias("normalized_bbox")] if {"width", "height"} <= set(pages.columns) else []),
    )


def elements_from_blocks(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements of pages with layout blocks (an array of label, bbox and content), and the malformed blocks."""
    each = pages.select("doc_id", "page_index", F.posexplode("blocks").alias("index", "b")).select("doc_id", "page_index", "index", F.col("b.label").alias("type"), F.col("b.bbox").alias("bbox"), F.col("b.content").alias("content"))
    good = F.coalesce((F.col("type") != "") & G.box_of("bbox").isNotNull() & F.col("content").isNotNull(), F.lit(False))
    joined = F.array_join("content", " ") if "array" in each.schema["content"].dataType.simpleString() else F.col("content")
    return each.filter(good).withColumn("content", joined), each.filter(~good)


def _aliases(c: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda a: F.trim(a)), lambda a: a != "")


def taxonomy_rows(raw: DataFrame) -> DataFrame:
    """Taxonomy nodes of rows (row from 1, node_id, parent_id, label, aliases, description, sort_order as strings): missing ids are topic-n, a missing order is the row."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return raw.select(
        F.coalesce(blank("node_id"), F.concat(F.lit("topic-"), "row")).alias("node_id"), blank("parent_id").alias("parent_id"), F.trim("label").alias("label"), _aliases("aliases").alias("aliases"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce(F.col("sort_order").try_cast("int"), F.col("row").cast("int")).alias("sort_order"),
    )


def _numbered_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of header CSV files with the columns named (missing ones null) and their number in the file."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path).withColumn("file", F.input_file_name()).withColumn("id", F.monotonically_increasing_id())
    rows = rows.select("file", "id", *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("id"))).drop("id", "file")


def read_taxonomy(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    columns = ("node_id", "parent_id", "label", "aliases", "description", "sort_order")
    if kind == "csv":
        return taxonomy_rows(_numbered_csv(spark, path, columns))
    rows = spark.read.schema(f"topics array<struct<{', '.join(f'{c}:' + ('array<string>' if c == 'aliases' else 'string') for c in columns)}>>").option("multiLine", True).json(path)
    each = rows.select(F.posexplode("topics").alias("i", "t")).select((F.col("i") + 1).alias("row"), "t.*")
    return taxonomy_rows(each.withColumn("aliases", F.array_join("aliases", "|")))


_CASE = "CFItems array<struct<identifier:string,uri:string,humanCodingScheme:string,fullStatement:string,abbreviatedStatement:string,parent_code:string,prerequisites:array<string>,replaces:array<string>>>"
_OBJECTIVE = ("stable_code", "title", "description", "parent_code", "prerequisites", "replaces", "identifier", "fullStatement")


def curriculum_rows(raw: DataFrame) -> DataFrame:
    """Objectives (row, stable_code, title, description, parent_code, prerequisites, replaces) of rows of strings; lists are separated by bars."""
    first = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    return raw.select("row", first("stable_code", "identifier").alias("stable_code"), first("title", "description", "fullStatement").alias("title"), first("description", "fullStatement", "title").alias("description"), first("parent_code").alias("parent_code"), _aliases("prerequisites").alias("prerequisites"), _aliases("replaces").alias("replaces"))


def read_curriculum(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Objectives of CSV, of a JSON list, or of a CASE document (``kind``)."""
    if kind == "csv":
        return curriculum_rows(_numbered_csv(spark, path, _OBJECTIVE))
    if kind == "json":
        rows = spark.read.schema(", ".join(f"{c} string" for c in _OBJECTIVE)).option("multiLine", True).json(path).withColumn("row", F.row_number().over(Window.partitionBy(F.input_file_name()).orderBy(F.monotonically_increasing_id())))
        return curriculum_rows(rows)
    each = spark.read.schema(_CASE).option("multiLine", True).json(path).select(F.posexplode("CFItems").alias("i", "c")).select((F.col("i") + 1).alias("row"), "c.*")
    return each.select(
        "row", F.coalesce("humanCodingScheme", "identifier").alias("stable_code"), F.coalesce("abbreviatedStatement", "fullStatement").alias("title"), F.col("fullStatement").alias("description"), "parent_code",
        F.coalesce("prerequisites", F.array().cast("array<string>")).alias("prerequisites"), F.coalesce("replaces", F.array().cast("array<string>")).alias("replaces"),
    )


def read_syllabus(spark: SparkSession, path: str, kind: str = "csv", case_style: str = "studio") -> DataFrame:
    """Syllabus objectives (row, objective_id, code, label, description, inferred, confirmed). Of CASE documents the studio style takes the statement as code and the code as label, the server style the reverse."""
    if kind == "case":
        each = spark.read.schema(_CASE).option("multiLine", True).json(path).select(F.posexplode("CFItems").alias("i", "c")).select((F.col("i") + 1).alias("row"), "c.*")
        code, label = ("fullStatement", "humanCodingScheme") if case_style == "studio" else ("humanCodingScheme", "fullStatement")
        rows = each.select("row", F.col("identifier").alias("objective_id"), F.col(code).alias("code"), F.col(label).alias("label"), F.col("fullStatement").alias("description"))
    else:
        rows = _numbered_csv(spark, path, ("objective_id", "code", "label", "description"))
    return rows.withColumn("inferred", F.lit(False)).withColumn("confirmed", F.lit(True))


def infer_objectives(texts: DataFrame, least: int = 8, most: int = 500) -> DataFrame:
    """doc_id, place and label of a text table's (doc_id, text) lines that may be objectives: stripped of bullets, of 8 characters or more, the first 500 of each document; inferred, not confirmed."""
    each = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("t", F.regexp_replace("raw", r"^[ \t\-•]+|[ \t\-•]+$", "")).filter(F.length("t") >= least)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return each.withColumn("place", place).filter(F.col("place") <= most).select("doc_id", "place", F.substring("t", 1, 256).alias("label"), F.lit(True).alias("inferred"), F.lit(False).alias("confirmed"))


def job_snapshots(raw: DataFrame) -> DataFrame:
    """Jobs of JSON snapshots (a column ``value``): a default name, the kind by the name's ending, the count by progress; unknown workflows and statuses go."""
    kind = "job_id string, input_name string, workflow string, input_kind string, status string, item_count int, progress struct<total_pages:int>, created_at timestamp"
    j = raw.select(F.from_json("value", kind).alias("j")).select("j.*")
    name = F.coalesce(F.nullif(F.trim("input_name"), F.lit("")), F.lit("document"))
    known = F.col("job_id").isNotNull() & F.col("workflow").isin("text_recognition", "document_parsing", "table_recognition", "formula_recognition") & F.col("status").isin("queued", "processing", "completed", "failed", "cancelled")
    return j.filter(known).select("job_id", name.alias("input_name"), "workflow", F.coalesce("input_kind", F.when(F.lower(name).endswith(".pdf"), "pdf").otherwise("image")).alias("input_kind"), "status", F.coalesce("item_count", "progress.total_pages").alias("item_count"), "created_at")


def expected_cases(manifest: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expected cases with their results, and an error row for each case without one."""
    return manifest.join(results, "case_id"), manifest.join(results, "case_id", "left_anti").select("case_id", F.lit("missing_result").alias("error"))


def sniff_media_type(content: Column) -> Column:
    """The media type that the first bytes tell, or null."""
    starts = lambda hexa, at=1: F.hex(F.substring(content, at, len(hexa) // 2)) == hexa
    return (
        F.when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8FF"), "image/jpeg").when(starts("255044462D"), "application/pdf").when(starts("49492A00") | starts("4D4D002A"), "image/tiff")
        .when(starts("424D"), "image/bmp").when(starts("52494646") & starts("57454250", 9), "image/webp").when(starts("504B0304"), "application/zip")
    )


def check_media(files: DataFrame) -> DataFrame:
    """Files (content, declared) with the sniffed type and whether it is the one declared."""
    return files.withColumn("sniffed", sniff_media_type(F.col("content"))).withColumn("accepted", F.coalesce(F.col("sniffed") == F.col("declared"), F.lit(False)))


def validate_outputs(outputs: DataFrame) -> DataFrame:
    """Worker outputs (kind, media_type, content) with a verdict: kind, media_type, content or ok."""
    allowed = {"result_json": ("application/json",), "markdown": ("text/markdown",), "preview": ("image/png",), "table_csv": ("text/csv",), "table_xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)}
    media = F.lit(False)
    for kind, types in allowed.items():
        media = media | ((F.col("kind") == kind) & F.col("media_type").isin(*types))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    zipped = F.hex(F.substring("content", 1, 4)) == "504B0304"
    good = F.when(F.col("kind") == "result_json", F.startswith(F.ltrim(text), F.lit("{")) & F.try_parse_json(text).isNotNull()).when(F.col("kind") == "preview", sniff_media_type(F.col("content")) == "image/png").when(F.col("kind").isin("table_xlsx", "docx"), zipped).otherwise(text.isNotNull())
    return outputs.withColumn("verdict", F.when(~F.col("kind").isin(*allowed), "kind").when(~media, "media_type").when(~F.coalesce(good, F.lit(False)), "content").otherwise("ok"))


def search_text_of(documents: DataFrame) -> DataFrame:
    """Documents with a bounded search text: the first of full_text, markdown and text that is not blank."""
    return documents.withColumn("search_text", X.search_text(*[c for c in ("full_text", "markdown", "text") if c in documents.columns]))

"""Exports and file manifests. Each export is a DataFrame of rows or text; ``write_text`` puts one in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.functions.keys import canonical_hash


def write_text(rows: DataFrame, path: str, order: Sequence[str], value: str = "value") -> None:
    """One line a row, files and lines in order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(value).write.text(path)


def export_case(objectives: DataFrame) -> DataFrame:
    """version_id and a CASE-shaped JSON document of its objectives (objective_id, stable_code, title, description, parent_code), in order of their codes."""
    item = F.struct(F.col("objective_id").alias("identifier"), F.col("stable_code").alias("humanCodingScheme"), F.col("description").alias("fullStatement"), F.col("title").alias("abbreviatedStatement"), F.col("parent_code").alias("parent_code"))
    per = objectives.groupBy("version_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stable_code", item.alias("i")))), lambda s: s["i"]).alias("CFItems"))
    return per.select("version_id", F.to_json(F.struct(F.struct(F.col("version_id").alias("identifier")).alias("CFDocument"), "CFItems")).alias("value"))


def export_taxonomy(nodes: DataFrame) -> DataFrame:
    """Taxonomy rows for CSV: aliases joined by bars."""
    return nodes.select("node_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), X.safe_csv_cell("label").alias("label"), F.array_join("aliases", "|").alias("aliases"), X.safe_csv_cell("description").alias("description"), "sort_order")


def exportable_bank(items: DataFrame) -> DataFrame:
    """Approved, fresh bank items with their export id: 16 digits of the content's hash."""
    good = items.filter((F.col("status") == "approved") & ~F.coalesce("stale", F.lit(False)))
    return good.withColumn("export_id", F.substring(canonical_hash("item_id", "text", "topic", "difficulty"), 1, 16))


def _xml(c: str) -> Column:
    out = F.coalesce(c, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def export_question_bank(items: DataFrame, kind: str = "jsonl") -> DataFrame:
    """item_id, export_id and value of each exportable item as csv, jsonl, markdown or qti."""
    rows = exportable_bank(items)
    fields = ["item_id", "text", "topic", "difficulty"]
    if kind == "csv":
        value = F.to_csv(F.struct(*[X.safe_csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in fields]))
    elif kind == "jsonl":
        value = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    elif kind == "markdown":
        value = F.format_string("## %s\n\n%s\n\n- Topic: %s\n- Difficulty: %s\n", F.col("item_id"), X.escape_markdown("text"), F.coalesce("topic", F.lit("Unmapped")), F.coalesce("difficulty", F.lit("unclassified")))
    elif kind == "qti":
        body = '<assessmentItem identifier="%s" title="%s" adaptive="false" timeDependent="false"><itemBody><p>%s</p><extendedTextInteraction responseIdentifier="RESPONSE"/></itemBody></assessmentItem>'
        value = F.format_string(body, _xml("item_id"), _xml("topic"), _xml("text"))
    else:
        raise ValueError(f"no such export: {kind}")
    return rows.select("item_id", "export_id", value.alias("value"))


def export_revision_pack(packs: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pack_id, place and Markdown of the packs' items, safe fields only, and the errors of approved packs: items that are missing, stale or not approved."""
    items = packs.select("pack_id", F.posexplode("item_ids").alias("place", "item_id"))
    met = items.join(bank.select("item_id", "text", "topic", "difficulty", "status", "stale"), "item_id", "left")
    good = F.coalesce((F.col("status") == "approved") & ~F.coalesce("stale", F.lit(False)), F.lit(False))
    lines = met.filter(good).select("pack_id", "place", F.format_string("%d. %s (%s)", F.col("place") + 1, X.escape_markdown("text"), F.coalesce("topic", F.lit("Unmapped"))).alias("value"))
    approved = packs.filter("status = 'approved'").select("pack_id")
    return lines, met.filter(~good).join(approved, "pack_id", "left_semi").select("pack_id", "item_id", F.lit("item_not_exportable").alias("error"))


def export_effective_view(lines: DataFrame, evidence: DataFrame) -> DataFrame:
    """doc_id and JSON of its effective lines with the hash of the evidence they rest on."""
    per = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line_id", "text", "raw_text", "corrected"))).alias("lines"))
    return per.join(evidence.select("doc_id", "content_hash"), "doc_id", "left").select("doc_id", F.to_json(F.struct(F.col("content_hash").alias("evidence_hash"), "lines")).alias("value"))


def export_dataset_release(manifest: DataFrame, items: DataFrame) -> DataFrame:
    """place and value: the manifest's line, then the items'. ``manifest`` (release_id, status, immutable, manifest_sha256) must be published and immutable, or there are no rows."""
    ready = manifest.filter("status = 'published' and immutable")
    first = ready.select(F.lit("").alias("place"), F.to_json(F.struct("manifest_sha256", "release_id")).alias("value"))
    rest = items.join(ready.select("release_id"), "release_id").select(F.col("item_id").cast("string").alias("place"), F.to_json(F.struct("content_sha256", "item_id", "split")).alias("value"))
    return first.union(rest)


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), size and sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("/")[-1]
    return files.select(F.regexp_extract("path", rf"/\Q{base}\E/(.*)$", 1).alias("path"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, files: DataFrame, suffixes: Sequence[str] = (".json", ".csv", ".md", ".png", ".jsonl", ".txt")) -> DataFrame:
    """path and verdict of every file named or found: duplicate_path, unsafe_path, suffix, missing_file, unlisted_file, size_mismatch, checksum_mismatch or ok."""
    named = manifest.groupBy("path").agg(F.count("*").alias("times"), F.first("size").alias("m_size"), F.first("sha256").alias("m_sha"))
    met = named.join(files.select("path", "size", "sha256"), "path", "full_outer")
    unsafe = F.col("path").startswith("/") | F.col("path").contains("\\") | F.array_contains(F.split("path", "/"), "..") | F.col("path").rlike("^[A-Za-z]:")
    allowed = F.lit(False)
    for s in suffixes:
        allowed = allowed | F.lower("path").endswith(s)
    verdict = F.when(F.col("times") > 1, "duplicate_path").when(unsafe, "unsafe_path").when(~allowed, "suffix").when(F.col("sha256").isNull(), "missing_file").when(F.col("m_sha").isNull(), "unlisted_file").when(F.col("m_size") != F.col("size"), "size_mismatch").when(F.lower("m_sha") != F.col("sha256"), "checksum_mismatch").otherwise("ok")
    return met.select("path", verdict.alias("verdict"))


def merge_imported_jobs(existing: DataFrame, incoming: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """All jobs after an import, and one row of counts: an incoming job whose id is taken gets one from its id and the batch, and keeps imported_from_job_id."""
    taken = existing.select("job_id").withColumn("taken", F.lit(True))
    met = incoming.join(taken, "job_id", "left").withColumn("imported_from_job_id", F.when(F.col("taken"), F.col("job_id")).otherwise(F.col("imported_from_job_id") if "imported_from_job_id" in incoming.columns else F.lit(None).cast("string")))
    new = met.withColumn("job_id", F.when(F.col("taken"), F.substring(F.sha2(F.concat_ws("\0", "job_id", F.lit(batch)), 256), 1, 32)).otherwise(F.col("job_id")))
    counts = new.agg(F.count("*").alias("imported"), F.count_if(F.coalesce("taken", F.lit(False))).alias("reassigned"))
    return existing.unionByName(new.drop("taken"), allowMissingColumns=True), counts


def import_lineage(jobs: DataFrame) -> DataFrame:
    """job_id and the id and name of the job that it was imported from."""
    source = jobs.select(F.col("job_id").alias("imported_from_job_id"), F.col("input_name").alias("source_name"))
    return jobs.filter("imported_from_job_id is not null").select("job_id", "imported_from_job_id").join(source, "imported_from_job_id", "left")


def batch_manifest(batches: DataFrame, items: DataFrame, results: DataFrame) -> DataFrame:
    """batch_id and JSON of its items by position: status and the output's hash, no source bytes."""
    each = items.join(results.select("item_id", "output_sha256"), "item_id", "left")
    per = each.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("position", "item_id", "status", "output_sha256"))).alias("items"))
    return batches.select("batch_id", "name").join(per, "batch_id", "left").select("batch_id", F.to_json(F.struct("batch_id", "name", "items"), {"ignoreNullFields": "false"}).alias("value"))


def write_safe_csv(grid: DataFrame, path: str, columns: Sequence[str]) -> None:
    grid.select(*[X.safe_csv_cell(F.col(c).cast("string")).alias(c) for c in columns]).write.option("header", True).csv(path)


def append_audit_jsonl(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)

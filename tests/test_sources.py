import hashlib
import json

from pyspark.sql import functions as F

from paperloom.sources import readers, sinks
from paperloom.streaming import events as stream


def test_results_and_broken_files(spark, tmp_path):
    d = tmp_path / "results"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"job_id": "a", "full_text": "x", "lines": [{"line_id": "p1", "text": "x", "confidence": 0.9, "page_index": 0}], "elements": [], "tables": [{"table_index": 0, "cells": [{"row": 0, "col": 0, "text": "c"}]}]}))
    (d / "b.json").write_text("{broken")
    out = readers.read_results(spark, str(d))
    assert out["documents"].count() == 1 and out["errors"].count() == 1 and out["lines"].first()["page_number"] == 1 and out["cells"].first()["text"] == "c"


def test_predictions(spark):
    p = spark.createDataFrame([(1, 0, ["a", "b"], [0.91234], [[1.0, 2.0, 3.0, 4.0]], [[0.0] * 8, [1.0] * 8])], "doc_id long, page_index int, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, rec_polys array<array<double>>")
    a, b = readers.lines_from_predictions(p).orderBy("seq").collect()
    assert (a["line_id"], a["confidence"], a["bbox"]) == ("p0001-l00001", 0.9123, [1.0, 2.0, 3.0, 4.0]) and b["confidence"] == 0.0 and b["bbox"] == [1.0] * 8


def test_taxonomy_and_curriculum_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("label,aliases\nForces,push|pull\nWaves,\n")
    rows = readers.read_taxonomy(spark, str(tmp_path / "t.csv")).orderBy("sort_order").collect()
    assert [(r["node_id"], r["aliases"], r["sort_order"]) for r in rows] == [("topic-1", ["push", "pull"], 1), ("topic-2", [], 2)]
    (tmp_path / "c.json").write_text(json.dumps({"CFItems": [{"identifier": "i", "humanCodingScheme": "CS-1", "fullStatement": "All of it"}]}))
    c = readers.read_curriculum(spark, str(tmp_path / "c.json"), "case").first()
    assert (c["stable_code"], c["title"], c["description"]) == ("CS-1", "All of it", "All of it")
    s = readers.read_syllabus(spark, str(tmp_path / "c.json"), "case").first()
    assert (s["code"], s["label"]) == ("All of it", "CS-1")
    assert "&amp;" not in sinks.export_case(spark.createDataFrame([("v", "o", "CS-1", "t", "d", None)], "version_id string, objective_id string, stable_code string, title string, description string, parent_code string")).first()["value"]


def test_manifest_verdicts(spark, tmp_path):
    root = tmp_path / "bundle"
    root.mkdir()
    for name in ("a.json", "b.json", "c.md"):
        (root / name).write_text(name)
    files = sinks.file_manifest(spark, str(root))
    found = {r["path"]: r for r in files.collect()}
    assert found["a.json"]["sha256"] == hashlib.sha256(b"a.json").hexdigest() and found["a.json"]["size"] == 6
    m = [("a.json", 6, found["a.json"]["sha256"]), ("b.json", 6, "0"), ("../x.json", 1, "0"), ("gone.json", 1, "0"), ("x.exe", 1, "0"), ("dup.json", 1, "0"), ("dup.json", 1, "0")]
    verdicts = {r["path"]: r["verdict"] for r in sinks.verify_manifest(spark.createDataFrame(m, "path string, size long, sha256 string"), files).collect()}
    assert verdicts == {"a.json": "ok", "b.json": "checksum_mismatch", "../x.json": "unsafe_path", "gone.json": "missing_file", "x.exe": "suffix", "dup.json": "duplicate_path", "c.md": "unlisted_file"}


def test_media_and_outputs(spark):
    png = bytes.fromhex("89504E470D0A1A0A") + b"x"
    f = spark.createDataFrame([(png, "image/png"), (b"%PDF-1.7", "image/png")], "content binary, declared string")
    assert [r["accepted"] for r in readers.check_media(f).collect()] == [True, False]
    o = spark.createDataFrame([("result_json", "application/json", b'{"a": 1}'), ("result_json", "application/json", b"[1]"), ("preview", "image/png", png), ("markdown", "text/csv", b"x"), ("other", "x", b"")], "kind string, media_type string, content binary")
    assert [r["verdict"] for r in readers.validate_outputs(o).collect()] == ["ok", "content", "ok", "media_type", "kind"]


def test_exports_keep_to_what_is_approved(spark):
    bank = spark.createDataFrame([("i1", "a <b>", "t", "low", "approved", False), ("i2", "x", "t", "low", "draft", False), ("i3", "y", "t", "low", "approved", True)], "item_id string, text string, topic string, difficulty string, status string, stale boolean")
    for kind in ("csv", "jsonl", "markdown", "qti"):
        rows = sinks.export_question_bank(bank, kind).collect()
        assert [r["item_id"] for r in rows] == ["i1"] and len(rows[0]["export_id"]) == 16
    assert "&lt;b&gt;" in rows[0]["value"]
    packs = spark.createDataFrame([("p", "approved", ["i1", "i2", "zz"])], "pack_id string, status string, item_ids array<string>")
    lines, errors = sinks.export_revision_pack(packs, bank)
    assert lines.count() == 1 and {r["item_id"] for r in errors.collect()} == {"i2", "zz"}


def test_imports_rename_what_collides(spark):
    old = spark.createDataFrame([("j1", "a")], "job_id string, input_name string").withColumn("imported_from_job_id", F.lit(None).cast("string"))
    new = spark.createDataFrame([("j1", "b"), ("j2", "c")], "job_id string, input_name string")
    merged, counts = sinks.merge_imported_jobs(old, new, "batch")
    assert merged.select("job_id").distinct().count() == 3 and tuple(counts.first()) == (2, 1)
    assert [r["source_name"] for r in sinks.import_lineage(merged).collect()] == ["a"]


def rows(spark, tmp_path, data, schema):
    at = str(tmp_path / "in")
    spark.createDataFrame(data, schema).write.parquet(at)
    return stream.event_stream(spark, at, spark.read.parquet(at).schema)


def test_stream_of_requests_agrees_with_batch(spark, tmp_path):
    from paperloom.operators import jobs

    data = [("k", 1, "h", 1), ("k", 2, "h", 2), ("k", 3, "z", 3), ("m", 4, "h", 4)]
    s = rows(spark, tmp_path, data, "key string, event_id long, request_hash string, ts long")
    got = {(r["event_id"], r["outcome"]) for r in stream.run_once(stream.idempotent_stream(s), str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    batch = jobs.idempotent(spark.createDataFrame(data, "key string, event_id long, request_hash string, ts long"), ("key",))
    assert got == {(r["event_id"], r["outcome"]) for r in batch.collect()} == {(1, "new"), (2, "replay"), (3, "conflict"), (4, "new")}


def test_status_machine_on_a_stream(spark, tmp_path):
    data = [("r", 1, "open", 1), ("r", 2, "in_review", 2), ("r", 3, "open", 3), ("q", 4, "open", 1)]
    s = rows(spark, tmp_path, data, "resource_id string, event_id long, status string, ts long")
    out = stream.run_once(stream.status_timeline(s, {("open", "in_review")}), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(r["event_id"], r["from_status"], r["to_status"]) for r in out.collect()] == [(3, "in_review", "open")]

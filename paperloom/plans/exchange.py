"""Queries of the readers, exports and file manifests: what is written is derived from the tables, read again and held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import reports
from paperloom.plans import sql as S
from paperloom.plans import views as V
from paperloom.plans.catalogue import EFFECTIVE, REVIEWS, _effective, _release_items, query
from paperloom.sources import readers, sinks
from paperloom.sources.staging import new_folder


@query("""WITH d AS (SELECT doc_id, text, lang, string_split(text, chr(10)) AS w FROM documents), l AS (SELECT doc_id, count(*) AS n_lines, sum(length(part)) AS n_chars FROM (SELECT doc_id, unnest(w) AS part FROM d) GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS job_id, coalesce(lang, '') AS language, n_lines, CAST(n_chars AS BIGINT) AS n_chars, 'document' AS kind FROM d JOIN l USING (doc_id) WHERE doc_id % 50 <> 7 UNION ALL SELECT '', '', count(*), 0, 'error' FROM d WHERE doc_id % 50 = 7 HAVING count(*) > 0""")
def results_read(spark, sf):
    at = new_folder(spark, "results")
    d = V.table(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.cast("int").alias("page_index"), p.alias("text"), F.lit(0.9).alias("confidence")))
    record = F.struct(F.when(F.col("doc_id") % 50 != 7, F.col("doc_id").cast("string")).alias("job_id"), F.coalesce("lang", F.lit("")).alias("language"), lines.alias("lines"))
    # a file is a JSON array of about a hundred records
    groups = d.select(F.floor(F.col("doc_id") / 100).alias("folder"), record.alias("r")).groupBy("folder").agg(F.to_json(F.collect_list("r")).alias("value"))
    groups.write.partitionBy("folder").text(at)
    found = readers.read_results(spark, at)
    per = found["lines"].groupBy("job_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))
    good = found["documents"].join(per, "job_id").select("job_id", "language", "n_lines", "n_chars", F.lit("document").alias("kind"))
    bad = found["errors"].agg(F.count("*").alias("n_lines")).filter("n_lines > 0").select(F.lit("").alias("job_id"), F.lit("").alias("language"), "n_lines", F.lit(0).cast("long").alias("n_chars"), F.lit("error").alias("kind"))
    return good.union(bad)


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, format('p{:04d}-l{:05d}', doc_id % 3 + 1, seq + 1) AS line_id, sha256(text) AS text_hash, CASE WHEN seq % 4 = 3 THEN 0.0 ELSE round(seq % 7 / 7.0, 4) END AS confidence,
CASE seq % 3 WHEN 0 THEN '10.0,' || CAST(CAST(seq AS DOUBLE) AS VARCHAR) || ',90.0,' || CAST(CAST(seq + 1 AS DOUBLE) AS VARCHAR) WHEN 1 THEN '1.0,2.0,3.0,2.0,3.0,4.0,1.0,4.0' ELSE '' END AS bbox FROM p""")
def prediction_lines(spark, sf):
    d = V.table(spark, sf, "documents")
    texts = F.split("text", "\n")
    score = F.transform(texts, lambda _, i: F.when(i % 4 != 3, F.round(i % 7 / F.lit(7.0), 6)))
    none = F.lit(None).cast("array<double>")
    boxes = F.transform(texts, lambda _, i: F.when(i % 3 == 0, F.array(F.lit(10.0), i.cast("double"), F.lit(90.0), (i + 1).cast("double"))).otherwise(none))
    polys = F.transform(texts, lambda _, i: F.when(i % 3 == 1, F.array(*[F.lit(float(x)) for x in (1, 2, 3, 2, 3, 4, 1, 4)])).otherwise(none))
    pages = d.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("page_index"), texts.alias("rec_texts"), score.alias("rec_scores"), boxes.alias("rec_boxes"), polys.alias("rec_polys"))
    return readers.lines_from_predictions(pages).select("doc_id", "seq", "line_id", F.sha2("text", 256).alias("text_hash"), "confidence", F.array_join(F.transform("bbox", lambda x: x.cast("string")), ",").alias("bbox"))


@query("""WITH p AS (SELECT page_id, unnest(string_split(url, '/')) AS part, unnest(range(len(string_split(url, '/')))) AS i FROM pages)
SELECT page_id AS doc_id, CAST(i AS INTEGER) AS index, CASE WHEN part <> '' AND i % 5 <> 4 THEN 'element' ELSE 'malformed' END AS kind, CASE WHEN part <> '' AND i % 5 <> 4 THEN part || ' ' || i END AS content FROM p""")
def layout_elements(spark, sf):
    parts = F.split("url", "/")
    block = F.transform(parts, lambda p, i: F.struct(F.when(p != "", F.lit("text")).otherwise("").alias("label"), F.when(i % 5 != 4, F.array(*[F.lit(float(x)) for x in (0, 0, 1, 1)])).otherwise(F.array(F.lit(1.0))).alias("bbox"), F.array(p, i.cast("string")).alias("content")))
    pages = V.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page_index"), block.alias("blocks"))
    good, bad = readers.elements_from_blocks(pages)
    return good.select("doc_id", "index", F.lit("element").alias("kind"), "content").union(bad.select("doc_id", "index", F.lit("malformed"), F.lit(None).cast("string")))


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'topic-' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) ELSE 'n' || p_partkey END AS node_id, CASE WHEN p_partkey % 2 = 0 THEN 'root' END AS parent_id, p_name AS label, p_type || '|x' AS aliases, CAST(p_size AS INTEGER) AS sort_order FROM part""")
def taxonomy_read(spark, sf):
    at, k = new_folder(spark, "taxonomy"), F.col("p_partkey")
    rows = V.table(spark, sf, "part").select(
        F.when(k % 3 != 0, F.concat(F.lit("n"), k.cast("string"))).otherwise("").alias("node_id"), F.when(k % 2 == 0, " root ").alias("parent_id"), "p_brand",
        F.concat(F.lit(" "), "p_name").alias("label"), F.concat("p_type", F.lit("| |x")).alias("aliases"), F.col("p_size").cast("string").alias("sort_order"), "p_partkey",
    )
    rows.repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey").drop("p_partkey").write.partitionBy("p_brand").option("header", True).csv(at)
    return readers.read_taxonomy(spark, at).select("node_id", "parent_id", "label", F.array_join("aliases", "|").alias("aliases"), "sort_order")


@query("SELECT 'id' || p_partkey AS objective_id, p_name AS code, 'C' || p_partkey AS label, false AS inferred, true AS confirmed FROM part")
def syllabus_read(spark, sf):
    return readers.read_syllabus(spark, _case_files(spark, sf), "case").select("objective_id", "code", "label", "inferred", "confirmed")


def _case_files(spark, sf) -> str:
    """A framework document for each brand."""
    at, k = new_folder(spark, "case"), F.col("p_partkey").cast("string")
    item = F.struct(F.concat(F.lit("id"), k).alias("identifier"), F.concat(F.lit("C"), k).alias("humanCodingScheme"), F.col("p_name").alias("fullStatement"), F.col("p_type").alias("abbreviatedStatement"), F.when(F.col("p_partkey") % 2 == 0, "C1").alias("parent_code"))
    documents = V.table(spark, sf, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("CFItems"))).alias("value"))
    documents.write.partitionBy("p_brand").text(at)
    return at


@query("SELECT 'C' || p_partkey AS stable_code, p_type AS title, p_name AS description, CASE WHEN p_partkey % 2 = 0 THEN 'C1' END AS parent_code, '' AS prerequisites, 'case' AS kind FROM part UNION ALL SELECT 'P' || p_partkey, p_name, p_name, NULL, 'P1|P2', 'csv' FROM part")
def curriculum_read(spark, sf):
    case = readers.read_curriculum(spark, _case_files(spark, sf), "case")
    at = new_folder(spark, "curriculum")
    V.table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("stable_code"), F.col("p_name").alias("title"), F.lit("P1| P2 |").alias("prerequisites")).write.option("header", True).csv(at)
    pick = lambda df, kind: df.select("stable_code", "title", "description", "parent_code", F.array_join("prerequisites", "|").alias("prerequisites"), F.lit(kind).alias("kind"))
    return pick(case, "case").union(pick(readers.read_curriculum(spark, at), "csv"))


@query("SELECT p_brand AS version_id, count(*) AS n_items, string_agg('C' || p_partkey, ',' ORDER BY 'C' || p_partkey) AS codes, p_brand AS identifier FROM part GROUP BY p_brand")
def case_export(spark, sf):
    k = F.col("p_partkey").cast("string")
    o = V.table(spark, sf, "part").select(F.col("p_brand").alias("version_id"), k.alias("objective_id"), F.concat(F.lit("C"), k).alias("stable_code"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("parent_code"))
    read = F.from_json("value", "CFDocument struct<identifier:string>, CFItems array<struct<humanCodingScheme:string>>")
    out = sinks.export_case(o).withColumn("r", read)
    return out.select("version_id", F.size("r.CFItems").cast("long").alias("n_items"), F.array_join("r.CFItems.humanCodingScheme", ",").alias("codes"), F.col("r.CFDocument.identifier").alias("identifier"))


@query("SELECT 'n' || p_partkey AS node_id, '' AS parent_id, CASE WHEN p_partkey % 4 = 0 THEN '''=' || p_name ELSE p_name END AS label, p_brand || '|' || p_type AS aliases, '''-x' AS description, CAST(p_size AS INTEGER) AS sort_order FROM part")
def taxonomy_export(spark, sf):
    k = F.col("p_partkey")
    nodes = V.table(spark, sf, "part").select(F.concat(F.lit("n"), k.cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.when(k % 4 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name")).alias("label"), F.array("p_brand", "p_type").alias("aliases"), F.lit("-x").alias("description"), F.col("p_size").cast("int").alias("sort_order"))
    return sinks.export_taxonomy(nodes)


BANK = S.cte(S.QUESTIONS) + ", bank AS (SELECT doc_id || ':' || group_no AS item_id, doc_id, group_no, text, topic, (doc_id + group_no) % 4 <> 3 AS approved, doc_id % 5 = 0 AS stale FROM questions)"


def _bank(spark, sf):
    key = (F.col("doc_id") + F.col("group_no")) % 4
    return V.questions(spark, sf).select("doc_id", "group_no", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("group_no").cast("string")).alias("item_id"), "text", "topic", "difficulty", F.when(key != 3, "approved").otherwise("draft").alias("status"), (F.col("doc_id") % 5 == 0).alias("stale"))


ESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(92), '&#92;'), '`', '&#96;'), '*', '&#42;'), '_', '&#95;'), '[', '&#91;'), ']', '&#93;')"


@query(BANK + f""", lost AS (SELECT doc_id AS pack_id, doc_id || ':0' AS item_id FROM (SELECT DISTINCT doc_id FROM bank))
SELECT doc_id AS pack_id, 'line' AS kind, sha256((group_no + 1) || '. ' || {ESCAPED} || ' (' || topic || ')') AS value FROM bank WHERE approved AND NOT stale
UNION ALL SELECT doc_id, 'error', item_id FROM bank WHERE (NOT approved OR stale) AND doc_id % 2 = 0 UNION ALL SELECT pack_id, 'error', item_id FROM lost WHERE pack_id % 2 = 0""")
def revision_pack(spark, sf):
    bank = _bank(spark, sf)
    # place 0 names an item that the bank lacks, so an item's place is its group number
    ids = F.concat(F.array(F.concat("doc_id", F.lit(":0"))), F.transform(F.array_sort(F.collect_list(F.struct("group_no", "item_id"))), lambda s: s["item_id"]))
    packs = bank.groupBy("doc_id").agg(ids.alias("item_ids")).select(F.col("doc_id").alias("pack_id"), "item_ids", F.when(F.col("doc_id") % 2 == 0, "approved").otherwise("draft").alias("status"))
    lines, errors = sinks.export_revision_pack(packs, bank)
    return lines.select("pack_id", F.lit("line").alias("kind"), F.sha2("value", 256).alias("value")).union(errors.select("pack_id", F.lit("error"), "item_id"))


@query(S.cte(S.LINES, S.CORRECTIONS) + EFFECTIVE + "SELECT e.doc_id, sha256(text) AS evidence_hash, n_lines, n_corrected FROM (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (corrected) AS n_corrected FROM e GROUP BY doc_id) e JOIN documents USING (doc_id)")
def effective_view(spark, sf):
    out = sinks.export_effective_view(_effective(spark, sf), V.evidence(spark, sf))
    read = F.from_json("value", "evidence_hash string, lines array<struct<line_id:string,corrected:boolean>>")
    return out.withColumn("r", read).select("doc_id", F.col("r.evidence_hash").alias("evidence_hash"), F.size("r.lines").cast("long").alias("n_lines"), F.size(F.filter("r.lines", lambda s: s["corrected"])).cast("long").alias("n_corrected"))


@query(REVIEWS + ", i AS (SELECT item_id, sha256(text) AS h FROM s JOIN documents ON doc_id = item_id WHERE state = 'gold') SELECT CAST(item_id AS VARCHAR) AS place, h AS content_sha256 FROM i UNION ALL SELECT '', 'r1'")
def release_export(spark, sf):
    items = _release_items(spark, sf).filter("state = 'gold'").withColumn("release_id", F.lit("r1")).withColumn("split", F.lit("train"))
    first = V.table(spark, sf, "labels").agg(F.lit("r1").alias("release_id"), F.lit("published").alias("status"), F.lit(True).alias("immutable"), F.sha2(F.count("*").cast("string"), 256).alias("manifest_sha256"))
    closed = first.withColumn("release_id", F.lit("r2")).withColumn("status", F.lit("draft"))
    out = sinks.export_dataset_release(first.union(closed), items)
    return out.select("place", F.coalesce(F.get_json_object("value", "$.content_sha256"), F.get_json_object("value", "$.release_id")).alias("content_sha256"))


@query("""WITH f AS (SELECT c_nationkey AS n, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS content FROM customer GROUP BY c_nationkey)
SELECT 'nation=' || n AS folder, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256, CASE n % 5 WHEN 1 THEN 'size_mismatch' WHEN 2 THEN 'checksum_mismatch' WHEN 3 THEN 'unlisted_file' ELSE 'ok' END AS verdict FROM f UNION ALL SELECT 'nation=x', NULL, NULL, 'missing_file'""")
def file_manifests(spark, sf):
    at = new_folder(spark, "files")
    rows = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_name", "c_custkey")
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "c_name").write.partitionBy("nation").text(at)
    files = sinks.file_manifest(spark, at).filter(F.col("path").endswith(".txt"))
    n = F.regexp_extract("path", r"nation=(\d+)", 1).cast("int") % 5
    listed = files.filter(n != 3).select("path", F.when(n == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(n == 2, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    gone = listed.limit(1).select(F.lit("nation=x/part.txt").alias("path"), "size", "sha256")
    verdicts = sinks.verify_manifest(listed.union(gone), files)
    return verdicts.join(files, "path", "left").select(F.regexp_extract("path", "^([^/]+)/", 1).alias("folder"), "size", "sha256", "verdict")


@query("""WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority AS input_name FROM orders WHERE o_orderkey % 3 <> 0), i AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderstatus AS input_name FROM orders WHERE o_orderkey % 2 = 0)
SELECT job_id, input_name, NULL AS imported_from_job_id, NULL AS source_name FROM e UNION ALL SELECT CASE WHEN e.job_id IS NULL THEN i.job_id ELSE substr(sha256(i.job_id || chr(0) || 'b1'), 1, 32) END, i.input_name, e.job_id, e.input_name FROM i LEFT JOIN e USING (job_id)""")
def jobs_imported(spark, sf):
    o, k = V.table(spark, sf, "orders"), F.col("o_orderkey")
    existing = o.filter(k % 3 != 0).select(k.cast("string").alias("job_id"), F.col("o_orderpriority").alias("input_name")).withColumn("imported_from_job_id", F.lit(None).cast("string"))
    incoming = o.filter(k % 2 == 0).select(k.cast("string").alias("job_id"), F.col("o_orderstatus").alias("input_name"))
    merged, _ = sinks.merge_imported_jobs(existing, incoming, "b1")
    return merged.select("job_id", "input_name", "imported_from_job_id").join(sinks.import_lineage(merged).select("job_id", "source_name"), "job_id", "left")


@query("SELECT count(*) FILTER (o_orderkey % 2 = 0) AS imported, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0) AS reassigned FROM orders")
def import_counts(spark, sf):
    o, k = V.table(spark, sf, "orders"), F.col("o_orderkey")
    existing = o.filter(k % 3 != 0).select(k.cast("string").alias("job_id"))
    return sinks.merge_imported_jobs(existing, o.filter(k % 2 == 0).select(k.cast("string").alias("job_id")), "b1")[1]


@query("SELECT l_orderkey AS batch_id, count(*) AS n_items, string_agg(l_linenumber || CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'queued' END || CASE l_linestatus WHEN 'F' THEN sha256(CAST(l_partkey AS VARCHAR)) ELSE '-' END, ',' ORDER BY l_linenumber) AS items FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) GROUP BY 1")
def batch_manifests(spark, sf):
    one = V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_linestatus", "l_partkey"), F.struct("l_partkey", "l_suppkey", "l_linestatus")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    item = F.concat_ws("-", "l_orderkey", "l_linenumber")
    items = one.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("position"), item.alias("item_id"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("queued").alias("status"))
    results = one.filter("l_linestatus = 'F'").select(item.alias("item_id"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("output_sha256"))
    batches = one.select(F.col("l_orderkey").alias("batch_id"), F.concat(F.lit("b"), "l_orderkey").alias("name")).distinct()
    read = F.from_json("value", "items array<struct<position:int,status:string,output_sha256:string>>")
    listed = F.array_join(F.transform("r.items", lambda i: F.concat(i["position"].cast("string"), i["status"], F.coalesce(i["output_sha256"], F.lit("-")))), ",")
    return sinks.batch_manifest(batches, items, results).withColumn("r", read).select("batch_id", F.size("r.items").cast("long").alias("n_items"), listed.alias("items"))


KINDS = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("255044462D", "application/pdf"), ("49492A00", "image/tiff"), ("424D", "image/bmp"), ("524946460000000057454250", "image/webp"), ("504B0304", "application/zip"), ("00", None))


@query("WITH k AS (SELECT doc_id, ['image/png', 'image/jpeg', 'application/pdf', 'image/tiff', 'image/bmp', 'image/webp', 'application/zip', NULL][doc_id % 8 + 1] AS sniffed, CASE WHEN doc_id % 3 = 0 THEN 'image/png' ELSE 'application/pdf' END AS declared FROM documents) SELECT doc_id, sniffed, declared, coalesce(sniffed = declared, false) AS accepted FROM k")
def media_checked(spark, sf):
    i = (F.col("doc_id") % 8 + 1).cast("int")
    head = F.element_at(F.array(*[F.lit(h) for h, _ in KINDS]), i)
    files = V.table(spark, sf, "documents").select("doc_id", F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"), F.when(F.col("doc_id") % 3 == 0, "image/png").otherwise("application/pdf").alias("declared"))
    return readers.check_media(files).drop("content")


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'content' WHEN 3 THEN 'ok' WHEN 4 THEN 'media_type' WHEN 5 THEN 'kind' ELSE 'content' END AS verdict FROM documents""")
def outputs_checked(spark, sf):
    text, i = F.encode("text", "UTF-8"), (F.col("doc_id") % 7 + 1).cast("int")
    cases = [
        ("result_json", "application/json", F.encode(F.to_json(F.struct("text")), "UTF-8")), ("markdown", "text/markdown", text), ("preview", "image/png", text),
        ("preview", "image/png", F.concat(F.unhex(F.lit("89504E470D0A1A0A")), text)), ("table_csv", "application/json", text), ("unheard", "text/markdown", text), ("markdown", "text/markdown", F.unhex(F.lit("FFFE"))),
    ]
    pick = lambda k: F.element_at(F.array(*[c[k] if k == 2 else F.lit(c[k]) for c in cases]), i)
    return readers.validate_outputs(V.table(spark, sf, "documents").select("doc_id", pick(0).alias("kind"), pick(1).alias("media_type"), pick(2).alias("content"))).select("doc_id", "verdict")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN left(ltrim(CAST(s_acctbal AS VARCHAR)), 1) IN ('-', '+', '=', '@') THEN '''' || s_acctbal ELSE CAST(s_acctbal AS VARCHAR) END AS balance, '''=' || s_name AS name FROM supplier")
def safe_csv(spark, sf):
    at = new_folder(spark, "csv")
    grid = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").cast("string").alias("balance"), F.concat(F.lit("="), "s_name").alias("name"))
    sinks.write_safe_csv(grid, at, ["id", "balance", "name"])
    return spark.read.option("header", True).csv(at)


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events GROUP BY event_type")
def audit_jsonl(spark, sf):
    at, e = new_folder(spark, "audit"), V.table(spark, sf, "events").select("event_id", "event_type")
    for half in (0, 1):  # appended in two goes
        sinks.append_audit_jsonl(e.filter(F.col("event_id") % 2 == half), at)
    return spark.read.schema("event_id long, event_type string").json(at).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_distinct"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'document' ELSE 'Scan ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE '.png' END END AS input_name, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN 'pdf' ELSE 'image' END AS input_kind,
CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE CAST(o_orderkey % 100 AS INTEGER) END AS item_count FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P'""")
def job_snapshots(spark, sf):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("Scan "), k.cast("string"), F.when(k % 2 == 0, ".PDF").otherwise(".png")))
    record = F.struct(
        k.cast("string").alias("job_id"), name.alias("input_name"), F.when(k % 7 == 0, "unheard").otherwise("document_parsing").alias("workflow"), F.when(F.col("o_orderstatus") == "P", "lost").otherwise("completed").alias("status"),
        F.when(k % 5 == 0, 7).alias("item_count"), F.struct((k % 100).alias("total_pages")).alias("progress"),
    )
    return readers.job_snapshots(V.table(spark, sf, "orders").select(F.to_json(record).alias("value"))).select("job_id", "input_name", "input_kind", "item_count")


@query("SELECT item_id AS case_id, doc_id IS NOT NULL AS found, CASE WHEN doc_id IS NULL THEN 'missing_result' END AS error FROM benchmark LEFT JOIN documents ON doc_id = item_id * 7")
def expected_cases(spark, sf):
    manifest = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("expected"))
    results = V.table(spark, sf, "documents").filter("doc_id % 7 = 0").select((F.col("doc_id") / 7).cast("long").alias("case_id"), F.col("text").alias("actual"))
    met, missing = readers.expected_cases(manifest, results)
    return met.select("case_id", F.lit(True).alias("found"), F.lit(None).cast("string").alias("error")).union(missing.select("case_id", F.lit(False), "error"))


@query(S.cte(S.QUESTIONS) + """, s AS (SELECT doc_id, group_no, '### ' || display_number || chr(10) || chr(10) || """ + ESCAPED + """ || chr(10) || chr(10) || 'Source: page ' || source_page || ', lines ' || replace(line_ids, ',', ', ') || chr(10) || 'Confidence: ' || coalesce(CAST(ocr_confidence AS VARCHAR), 'not available')
|| chr(10) || 'Topic: ' || topic || chr(10) || 'Difficulty: ' || difficulty || chr(10) || 'Marks: ' || coalesce(CAST(marks AS VARCHAR), 'not detected') || chr(10) AS t FROM questions) SELECT doc_id, sha256('# Question analysis' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY group_no)) AS report_hash FROM s GROUP BY doc_id""")
def analysis_report(spark, sf):
    return reports.analysis_markdown(V.questions(spark, sf)).select("doc_id", F.sha2("markdown", 256).alias("report_hash"))


@query("SELECT doc_id, sha256(substr(CASE WHEN doc_id % 3 = 0 OR trim(text) = '' THEN coalesce(nullif(trim(coalesce(lang, '')), ''), '') ELSE trim(text) END, 1, 100000)) AS search_hash FROM documents")
def search_texts(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("   ").alias("full_text"), F.lit("").alias("markdown"), F.col("lang").alias("text"))
    return readers.search_text_of(d).select("doc_id", F.sha2("search_text", 256).alias("search_hash"))

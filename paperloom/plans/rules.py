"""Queries of the validators, gates, filters and feeds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as X
from paperloom.operators import curriculum, datasets, enrich, governance, jobs, overlays, reconcile, reports
from paperloom.plans import sql as S
from paperloom.plans import views as V
from paperloom.plans.catalogue import COVERAGE, REVIEWS, _dispositions, _release_items, query
from paperloom.plans.exchange import BANK, _bank

NOON = datetime(2024, 1, 15)


@query(BANK + " SELECT item_id, approved FROM bank WHERE approved AND contains(lower(text), 'the') ORDER BY doc_id * 1000 + group_no DESC, item_id LIMIT 500")
def bank_filter(spark, sf):
    items = _bank(spark, sf).select("item_id", "status", F.col("text").alias("payload"), (F.col("doc_id") * 1000 + F.col("group_no")).alias("updated_at"))
    return jobs.filter_bank(items, "approved", "%The", 9999).select("item_id", (F.col("status") == "approved").alias("approved"))


@query("SELECT event_id, ts AS created_at FROM events WHERE event_type = 'error' AND (event_id % 3 = 0 OR ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15')")
def outbox_filter(spark, sf):
    due = F.when(F.col("event_id") % 3 != 0, jobs.seconds_later("ts", F.lit(86400)))
    e = V.table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "pending").otherwise("done").alias("status"), due.alias("next_attempt_at"))
    return jobs.filter_outbox(e, "pending", NOON).select("event_id", "created_at")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' AND user_id % 10 = 3")
def audit_filter(spark, sf):
    e = V.table(spark, sf, "events").withColumn("tenant", F.col("user_id") % 10).withColumnRenamed("ts", "created_at")
    return jobs.filter_audit(e, event_type="view", tenant=3).select("event_id", "user_id")


@query(S.cte(S.JOBS) + "SELECT count(*) AS total, count(*) FILTER (pinned) AS pinned FROM jobs")
def job_total(spark, sf):
    return jobs.job_total(V.jobs(spark, sf))


@query("SELECT user_id % 10 AS tenant, event_id AS sequence FROM events WHERE event_id % 97 = 5")
def audit_recomputed(spark, sf):
    """Chains whose links all hold, but some of whose bodies were changed afterwards: only the hashes tell."""
    e = V.table(spark, sf, "events").select((F.col("user_id") % 10).alias("tenant"), F.col("event_id").alias("sequence"), F.concat_ws("|", "event_type", "props").alias("body"))
    chained = governance.chain_audit(e)
    changed = chained.withColumn("body", F.when(F.col("sequence") % 97 == 5, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    again = F.sha2(F.concat(F.coalesce("previous_hash", F.lit("")), "body"), 256)
    return governance.verify_audit_chain(changed, recompute=again).select("tenant", "sequence")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_recent(spark, sf):
    return jobs.filter_audit(V.table(spark, sf, "events").withColumnRenamed("ts", "created_at"), newest=20).select("event_id", "event_type")


@query("""SELECT doc_id AS item_id, CASE WHEN toxic = 1 AND doc_id % 2 <> 0 THEN 'not_deidentified' WHEN doc_id % 4 IN (2, 3) THEN 'project_closed' END AS reason FROM labels""")
def items_admitted(spark, sf):
    items = V.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 4).alias("project_id"), (F.col("toxic") == 1).alias("contains_student_data"), (F.col("doc_id") % 2 == 0).alias("deidentified"))
    projects = items.select("project_id").distinct().filter("project_id < 3").withColumn("status", F.element_at(F.array(F.lit("draft"), F.lit("active"), F.lit("archived")), (F.col("project_id") + 1).cast("int")))
    good, bad = datasets.admit_items(items, projects)
    return good.select("item_id", F.lit(None).cast("string").alias("reason")).union(bad.select("item_id", "reason"))


@query("SELECT doc_id, lang AS language, CASE WHEN lang = (SELECT min(lang) FROM documents) THEN 'supported' ELSE 'unsupported' END AS question_segmentation FROM documents")
def language_gate(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"))
    known = d.agg(F.min("language").alias("language"), F.lit("supported").alias("question_segmentation"))
    return governance.language_gate(d, known).select("doc_id", "language", "question_segmentation")


CRITERIA = """WITH c AS (SELECT o_orderkey % 5000 AS rubric_id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN 'same' ELSE 'c' || o_orderkey END AS id, CASE WHEN o_orderkey % 17 = 0 THEN -5.0 ELSE 25.0 END AS weight FROM orders),
p AS (SELECT rubric_id, count(*) FILTER (trim(id) = '') AS blank, count(*) - count(DISTINCT id) AS twice, count(*) FILTER (weight < 0) AS negative, sum(weight) AS total FROM c GROUP BY rubric_id)
"""


@query(CRITERIA + "SELECT rubric_id, 'missing_id' AS rule FROM p WHERE blank > 0 UNION ALL SELECT rubric_id, 'duplicate_id' FROM p WHERE twice > 0 UNION ALL SELECT rubric_id, 'negative_weight' FROM p WHERE negative > 0 UNION ALL SELECT rubric_id, 'total' FROM p WHERE abs(total) > 0.01 AND abs(total - 100) > 0.01")
def rubric_check(spark, sf):
    k = F.col("o_orderkey")
    item = F.struct(F.when(k % 11 == 0, " ").when(k % 13 == 0, "same").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("id"), F.when(k % 17 == 0, -5.0).otherwise(25.0).alias("weight"))
    return curriculum.validate_rubrics(V.table(spark, sf, "orders").groupBy((k % 5000).alias("rubric_id")).agg(F.collect_list(item).alias("criteria")))


@query("SELECT l_orderkey || '-' || l_linenumber AS id, 'l_shipdate>other' AS rule FROM lineitem WHERE DATE '1995-06-01' < l_shipdate")
def range_check(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_shipdate", F.lit(datetime(1995, 6, 1)).alias("other"))
    return overlays.validate_ranges(rows, "id", [("l_shipdate", "other")])


@query(S.cte(S.LINES, S.CORRECTIONS) + """, x AS (SELECT correction_id, doc_id, target_id, doc_id % 6 AS m FROM corrections)
SELECT correction_id, 'kind' AS rule FROM x WHERE m = 1 UNION ALL SELECT correction_id, 'status' FROM x WHERE m = 2 UNION ALL SELECT correction_id, 'reason' FROM x WHERE m = 3 UNION ALL SELECT correction_id, 'geometry' FROM x WHERE m = 4 UNION ALL SELECT correction_id, 'missing_target' FROM x WHERE m = 5""")
def correction_check(spark, sf):
    m, c = F.col("doc_id") % 6, V.corrections(spark, sf)
    bad = c.withColumns({
        "target_kind": F.when(m == 1, "page").otherwise(F.col("target_kind")), "status": F.when(m == 2, "lost").otherwise(F.col("status")), "reason": F.when(m == 3, "  ").otherwise(F.col("reason")),
        "geometry": F.when(m == 4, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.4), F.lit(0.2))), "target_id": F.when(m == 5, F.concat("target_id", F.lit("x"))).otherwise(F.col("target_id")),
    })
    return overlays.validate_corrections(bad, V.lines(spark, sf))


@query(S.cte(S.QUESTIONS) + "SELECT doc_id, question_id FROM questions WHERE (doc_id + group_no) % 6 = 0")
def mapping_check(spark, sf):
    q = V.questions(spark, sf)
    key = F.col("doc_id") + F.col("group_no")
    rows = q.select("doc_id", "question_id", F.when(key % 2 == 0, "approved").otherwise("draft").alias("status"), F.when(key % 3 == 0, "model").otherwise("teacher").alias("method"))
    return overlays.validate_mappings(rows).select("doc_id", "question_id")


@query(S.cte(S.QUESTIONS) + """, x AS (SELECT doc_id || ':' || group_no AS question_id, (doc_id + group_no) % 5 AS m FROM questions)
SELECT question_id, CASE m WHEN 1 THEN 'field' WHEN 2 THEN 'difficulty' WHEN 3 THEN 'status' ELSE 'marks' END AS rule FROM x WHERE m > 0""")
def override_check(spark, sf):
    m = (F.col("doc_id") + F.col("group_no")) % 5
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    override = F.when(m == 1, one("colour", "red")).when(m == 2, one("difficulty", "odd")).when(m == 3, one("review_status", "odd")).when(m == 4, one("marks", "101")).otherwise(F.create_map(F.lit("marks"), F.lit("100"), F.lit("difficulty"), F.lit("low"), F.lit("topic"), F.lit("x")))
    return overlays.validate_overrides(V.questions(spark, sf).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("group_no").cast("string")).alias("question_id"), override.alias("override")))


@query("""SELECT o_orderkey AS script_id, c_name AS line_item, CASE WHEN c_name IS NULL THEN 'identity_not_mapped' END AS reject_reason FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0""")
def grade_returns(spark, sf):
    o, k = V.table(spark, sf, "orders"), F.col("o_orderkey")
    scripts = o.select(k.alias("script_id"), F.col("o_custkey").alias("pseudonym"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("status"), (k % 2 == 0).alias("return_grade"), F.when(k % 5 == 0, F.col("o_orderdate")).alias("published_at"))
    known = V.table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("pseudonym"), F.col("c_name").alias("line_item"))
    return governance.grade_return_feed(scripts, known).select("script_id", "line_item", "reject_reason")


@query("SELECT l_orderkey || '-' || l_linenumber AS script_id, 'rubric_not_published' AS rule FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0) UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'assessment_missing' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def rubric_gate(spark, sf):
    scripts = V.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("script_id"), F.col("l_suppkey").alias("rubric_id"), F.col("l_partkey").alias("assessment_id"))
    rubrics = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rubric_id"), F.when(F.col("s_suppkey") % 4 != 0, "published").otherwise("draft").alias("status"))
    return governance.rubric_gate(scripts, rubrics, V.table(spark, sf, "part").filter("p_size > 5").select(F.col("p_partkey").alias("assessment_id")))


@query("""WITH o AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 20 = 1 THEN ' ' WHEN p_partkey % 20 = 2 THEN 'p-' || (p_partkey + 1) ELSE 'P-' || p_partkey END AS code, CASE WHEN p_partkey % 4 = 0 THEN 'P-' || (p_partkey * 2) END AS parent, 'P-' || (p_partkey * 3) AS pre FROM part),
g AS (SELECT *, row_number() OVER (PARTITION BY lower(code) ORDER BY row) AS n FROM o WHERE trim(code) <> ''), k AS (SELECT * FROM g WHERE n = 1)
SELECT row, 'required_field' AS rule FROM o WHERE trim(code) = '' UNION ALL SELECT row, 'duplicate_code' FROM g WHERE n > 1 UNION ALL SELECT row, 'unknown_parent' FROM k WHERE parent IS NOT NULL AND parent NOT IN (SELECT code FROM k) UNION ALL SELECT row, 'unknown_prerequisite' FROM k WHERE pre NOT IN (SELECT code FROM k)""")
def objective_check(spark, sf):
    k = F.col("p_partkey")
    p = lambda n: F.concat(F.lit("P-"), n.cast("string"))
    code = F.when(k % 20 == 1, " ").when(k % 20 == 2, F.lower(p(k + 1))).otherwise(p(k))
    o = V.table(spark, sf, "part").select(k.alias("row"), code.alias("stable_code"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.when(k % 4 == 0, p(k * 2)).alias("parent_code"), F.array(p(k * 3)).alias("prerequisites"), F.lit(None).cast("array<string>").alias("replaces"))
    return curriculum.validate_objectives(o)


@query(BANK + " SELECT doc_id AS pack_id, item_id, CASE WHEN stale THEN 'stale' ELSE 'not_approved' END AS reason FROM bank WHERE stale OR NOT approved UNION ALL SELECT DISTINCT doc_id, doc_id || ':x', 'missing' FROM bank")
def pack_check(spark, sf):
    bank = _bank(spark, sf)
    packs = bank.groupBy(F.col("doc_id").alias("pack_id")).agg(F.concat(F.collect_list("item_id"), F.array(F.concat("doc_id", F.lit(":x")))).alias("item_ids"))
    return curriculum.check_pack_items(packs, bank)


@query(S.cte(S.QUESTIONS) + """SELECT doc_id, group_no, CASE WHEN (doc_id + group_no) % 3 <> 0 THEN 'teacher_reviewed' ELSE 'needs_teacher_review' END AS review_status, CASE WHEN (doc_id + group_no) % 3 <> 0 THEN 'kept' END AS topic_override FROM questions""")
def overrides_carried(spark, sf):
    q = V.questions(spark, sf)
    key = F.col("doc_id") + F.col("group_no")
    prior = q.filter(key % 3 != 0).select("doc_id", "question_id", F.create_map(F.lit("topic"), F.lit("kept")).alias("teacher_override"), F.lit("teacher_reviewed").alias("review_status"))
    return overlays.carry_over(q, prior).select("doc_id", "group_no", "review_status", F.col("teacher_override")["topic"].alias("topic_override"))


GROUNDED = S.cte(S.QUESTIONS) + """, x AS (SELECT doc_id, question_id, group_no, (doc_id + group_no) % 6 AS m FROM questions)
SELECT doc_id, CASE WHEN m = 1 THEN 'lost' ELSE question_id END AS question_id, CASE m WHEN 1 THEN 'unknown_question' WHEN 2 THEN 'wrong_page' WHEN 3 THEN 'ungrounded_lines' WHEN 4 THEN 'bad_difficulty' ELSE 'ok' END AS verdict, count(*) AS n FROM x GROUP BY ALL"""


def _model_rows(spark, sf):
    m = (F.col("doc_id") + F.col("group_no")) % 6
    return V.questions(spark, sf).select(
        "doc_id", F.when(m == 1, "lost").otherwise(F.col("question_id")).alias("question_id"), (F.col("source_page") + F.when(m == 2, 1).otherwise(0)).alias("ai_source_page"),
        F.when(m == 3, F.array(F.lit("x"))).otherwise(F.slice("source_line_ids", 1, 1)).alias("ai_source_line_ids"), F.col("topic"), F.when(m == 4, "odd").otherwise(F.col("difficulty")).alias("difficulty"),
    )


@query(GROUNDED)
def grounding_check(spark, sf):
    return enrich.validate_grounding(V.questions(spark, sf), _model_rows(spark, sf)).groupBy("doc_id", "question_id", "verdict").agg(F.count("*").alias("n"))


@query(S.cte(S.QUESTIONS) + "SELECT doc_id, question_id, CASE WHEN length(text) % 2 = 0 THEN 'low' ELSE 'high' END AS difficulty, 'ok' AS verdict, 'primary' AS model FROM questions WHERE doc_id % 3 <> 0")
def questions_enriched(spark, sf):
    def classify(batch):
        level = ["low" if len(t) % 2 == 0 else "high" for t in batch["text"]]
        return batch.assign(topic="t", difficulty=level)[["question_key", "question_id", "source_page", "source_line_ids", "topic", "difficulty"]]

    q = V.questions(spark, sf).withColumn("consent", F.col("doc_id") % 3 != 0)
    return enrich.enrich_questions(q, classify).select("doc_id", "question_id", "difficulty", "verdict", "model")


@query("SELECT c_mktsegment AS path, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS INTEGER) AS seq, c_name AS text, 0.5::DOUBLE AS confidence FROM customer")
def pages_read(spark, sf):
    """Pages of text bytes, one for each segment, go through the hook for readers of images."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda s: s["c_name"])
    pages = V.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("path")).agg(F.encode(F.array_join(names, "\n"), "UTF-8").alias("content"))
    return enrich.ocr_pages(pages, lambda content: [{"text": t, "confidence": 0.5} for t in bytes(content).decode().split("\n")]).drop("bbox")


@query(S.cte(S.LINES) + """, g AS (SELECT DISTINCT doc_id, page_number FROM lines), t AS (SELECT *, unnest([0, 1, 2]) AS table_index FROM g), y AS (SELECT *, 0.1 + 0.3 * table_index AS y1, 0.3 + 0.3 * table_index AS y2 FROM t)
SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, table_index, CASE WHEN table_index < 2 OR doc_id % 2 = 0 THEN table_index + 10 END AS block_index, CASE WHEN table_index < 2 OR doc_id % 2 = 0 THEN round(0.15 / 0.2, 6) ELSE 0.0 END AS score FROM y""")
def tables_matched(spark, sf):
    pages = V.lines(spark, sf).select("doc_id", "page_number").distinct()
    each = pages.withColumn("table_index", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    box = lambda low: F.array(F.lit(0.1), low, F.lit(0.9), low + 0.2)
    top = F.lit(0.1) + F.col("table_index") * 0.3
    tables = each.withColumn("normalized_bbox", box(top))
    # each table's block covers three quarters of it; on odd documents the last block is missing
    blocks = each.filter("table_index < 2 or doc_id % 2 = 0").select("doc_id", "page_number", (F.col("table_index") + 10).alias("block_index"), F.array(F.lit(0.1), top, F.lit(0.9), top + 0.15).alias("normalized_bbox"))
    return reconcile.match_tables_to_blocks(tables, blocks).withColumn("score", F.round("score", 6))


@query("SELECT count(*) FILTER (event_type = 'purchase') AS delivered, count(*) FILTER (event_type IN ('view', 'click')) AS pending, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM events")
def delivery_counts(spark, sf):
    kind = F.col("event_type")
    return reports.delivery_counts(V.table(spark, sf, "events").select(F.when(kind == "purchase", "delivered").when(kind.isin("view", "click"), "pending").when(kind == "error", "failed").otherwise("other").alias("status")))


@query("SELECT count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS pending_after_error FROM events")
def sync_counts(spark, sf):
    kind = F.col("event_type")
    return reports.sync_counts(V.table(spark, sf, "events").select(F.when(kind == "purchase", True).when(kind == "error", False).alias("ok")))


@query("SELECT l_orderkey AS doc_id, CAST(sum(l_linenumber) AS BIGINT) AS adaptive_retry_attempted, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS adaptive_retry_accepted FROM lineitem GROUP BY 1")
def retry_summary(spark, sf):
    pages = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("adaptive_retry_attempted"), F.when(F.col("l_linenumber") % 2 == 0, 1).alias("adaptive_retry_accepted"))
    return reports.retry_summary(pages)


@query("""WITH c AS (SELECT item_id, text AS e, CASE WHEN item_id % 2 = 0 THEN replace(text, 'e', 'c') ELSE text END AS a FROM benchmark), w AS (SELECT *, string_split(trim(regexp_replace(e, '\\s+', ' ', 'g')), ' ') AS ew, string_split(trim(regexp_replace(a, '\\s+', ' ', 'g')), ' ') AS aw FROM c)
SELECT item_id AS case_id, CASE WHEN item_id % 9 = 0 THEN 'missing_result' END AS error, CASE WHEN item_id % 9 <> 0 THEN round(levenshtein(e, a) / length(e), 6) END AS character_error_rate,
CASE WHEN item_id % 9 <> 0 THEN round(len(list_filter(list_zip(ew, aw), lambda p: p[1] = p[2])) / len(ew), 6) END AS reading_order_accuracy, CASE WHEN item_id % 9 <> 0 THEN round(least(item_id % 4, 2) / greatest(item_id % 4, 1), 6) + CASE WHEN item_id % 4 = 0 THEN 0.0 ELSE 0.0 END END AS table_handling_accuracy,
CASE WHEN item_id % 9 <> 0 THEN 0.5 END AS source_traceability, CASE WHEN item_id % 9 <> 0 THEN CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END END AS ai_grounding_rate FROM w""".replace("\\\\", "\\"))
def case_scores(spark, sf):
    b, k = V.table(spark, sf, "benchmark"), F.col("item_id")
    words = F.split(X.clean("text"), " ")
    zero = F.lit(0)
    expected = b.select(k.alias("case_id"), "text", words.alias("question_numbers"), words.alias("reading_order"), (k % 4).cast("int").alias("tables"), zero.alias("figures"), zero.alias("equations"))
    spoiled = F.when(k % 2 == 0, F.replace("text", F.lit("e"), F.lit("c"))).otherwise(F.col("text"))
    line = lambda name: F.array(F.lit(name))
    ai = F.struct(F.when(k % 2 == 0, line("l1")).otherwise(line("l9")).alias("source_line_ids"), F.lit(1).alias("source_page"), F.lit("q1").alias("question_id"))
    questions = F.array(F.struct(F.lit("q1").alias("question_id"), F.lit(1).alias("source_page"), line("l1").alias("source_line_ids"), ai.alias("ai")), F.struct(F.lit("q2").alias("question_id"), F.lit(0).alias("source_page"), line("l2").alias("source_line_ids"), F.lit(None).cast(V.AI).alias("ai")))
    other = F.split(X.clean(spoiled), " ")
    actual = b.filter(k % 9 != 0).select(k.alias("case_id"), spoiled.alias("full_text"), other.alias("display_numbers"), other.alias("line_order"), F.when(k % 4 == 0, 1).otherwise(2).alias("n_tables"), zero.alias("n_figures"), zero.alias("n_equations"), questions.alias("questions"))
    return reports.score_cases(expected, actual).select("case_id", "error", "character_error_rate", "reading_order_accuracy", "table_handling_accuracy", "source_traceability", "ai_grounding_rate")


@query(S.cte(S.LINES) + """, x AS (SELECT doc_id, page_number, seq, text, unnest([0, 1]) AS again FROM lines WHERE trim(text) <> ''), o AS (SELECT *, 2 * seq + again AS s FROM x WHERE again = 0 OR seq % 5 = 0),
k AS (SELECT *, lag(text) OVER w AS pt, lag(seq) OVER w AS ps FROM o WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY s)) SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, CAST(s AS INTEGER) AS seq, sha256(text) AS content_hash FROM k WHERE NOT coalesce(pt = text AND ps = seq, false)""")
def adjacent_duplicates(spark, sf):
    """Every fifth line is read twice at the same place."""
    lines = V.lines(spark, sf).filter("trim(text) <> ''")
    twice = lines.withColumn("again", F.explode(F.when(F.col("seq") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    found = reconcile.suppress_adjacent_duplicates(twice.select("doc_id", "page_number", (F.col("seq") * 2 + F.col("again")).alias("seq"), F.col("text").alias("content"), "normalized_bbox"))
    return found.select("doc_id", "page_number", "seq", F.sha2("content", 256).alias("content_hash"))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS col, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN '.' || (l_partkey + 10) WHEN l_linenumber % 3 = 2 THEN 'x' || l_partkey ELSE CAST(l_partkey + 10 AS VARCHAR) END AS text FROM lineitem), n AS (SELECT *, count(*) FILTER (regexp_matches(trim(text), '^[.·。]?\\d{2,}$')) OVER (PARTITION BY doc_id) AS n FROM c)
SELECT doc_id, col, CASE WHEN n >= 3 AND starts_with(text, '.') THEN substr(text, 2) ELSE text END AS text FROM n""".replace("\\\\", "\\"))
def integer_rows(spark, sf):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    text = F.when(n == 1, F.concat(F.lit("."), (p + 10).cast("string"))).when(n % 3 == 2, F.concat(F.lit("x"), p.cast("string"))).otherwise((p + 10).cast("string"))
    cells = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_index"), F.lit(0).alias("row"), n.alias("col"), text.alias("text"))
    return reconcile.clean_integer_rows(cells).select("doc_id", "col", "text")


@query("SELECT event_id, 'expired' AS status FROM events WHERE event_type = 'view' AND ts + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-15'")
def expired_sources(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "staged").otherwise("consumed").alias("status"), F.col("ts").alias("created_at"))
    return jobs.expired_sources(e, NOON).select("event_id", "status")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN user_id % 2 = 0 THEN 'failed' ELSE 'queued' END ELSE 'done' END AS status, event_type IN ('view', 'click') AND user_id % 2 = 1 AS retry FROM l WHERE rn = 1""")
def interrupted_recovered(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type").isin("view", "click"), "processing").otherwise("done").alias("status"), F.when(F.col("user_id") % 2 == 0, "job").otherwise("item").alias("kind"))
    return jobs.recover_interrupted(jobs.latest_state(e, "user_id", "ts", "event_id")).select("user_id", "status", "retry")


@query(S.cte(S.LINES) + r""", t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY seq) AS text FROM lines WHERE page_number <= 2 GROUP BY doc_id),
d AS (SELECT doc_id, regexp_extract_all(text, '(?:subject\s*code|full\s*marks|examination|answer\s+any|\b\d+\s*[.)]\s*\(?[a-z]\)?)', 0, 'i') AS a, regexp_extract_all(text, '(?:^|\s)\([a-z]\)\s', 0, 'i') AS b FROM t)
SELECT doc_id, CASE WHEN len(a) + least(len(b), 3) >= 3 THEN 'exam' ELSE 'general' END AS document_profile FROM d""")
def document_profiles(spark, sf):
    lines = V.lines(spark, sf).select("doc_id", "seq", (F.col("page_number") - 1).alias("page_index"), F.col("text").alias("content"))
    return reports.document_profiles(lines)


@query(S.cte(S.LINES, S.ELEMENTS) + """, e AS (SELECT doc_id, count(*) FILTER (type = 'figure') AS f, count(*) FILTER (type = 'formula') AS m FROM elements GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE doc_id % 5 END AS n_tables, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE f END AS n_figures, CASE WHEN doc_id % 6 = 0 THEN 9 WHEN doc_id % 4 = 1 THEN 3 ELSE m END AS n_equations FROM e""")
def feature_counts(spark, sf):
    d = F.col("doc_id")
    items = lambda n: F.sequence(F.lit(1), n).cast("array<string>")
    none = F.array().cast("array<string>")
    kinds = V.elements(spark, sf).groupBy("doc_id").agg(F.collect_list(F.struct("type")).alias("elements"))
    results = kinds.select("doc_id", "elements", F.when(d % 3 == 0, 4).alias("table_count"), F.when(d % 5 == 0, none).otherwise(items((d % 5).cast("int"))).alias("tables"), F.lit(None).cast("int").alias("figure_count"), F.when(d % 4 == 0, items(F.lit(2))).otherwise(none).alias("figures"), F.when(d % 6 == 0, 9).alias("equation_count"), F.when(d % 4 == 1, items(F.lit(3))).alias("equations"))
    return results.select("doc_id", *[c.cast("long").alias(n) for n, c in reports.feature_counts().items()])


@query(S.cte(S.QUESTIONS) + "SELECT doc_id, count(*) FILTER ((doc_id + group_no) % 2 = 0) AS n_items, coalesce(string_agg(question_id || '=' || sha256(text), ',' ORDER BY group_no) FILTER ((doc_id + group_no) % 2 = 0), '') AS items FROM questions GROUP BY doc_id")
def student_items(spark, sf):
    item = F.struct("question_id", "text", "topic", F.lit(None).cast("string").alias("objective"), "difficulty", F.lit("en").alias("language"), F.lit("archive").alias("provenance"), F.lit(None).cast("string").alias("accessibility_description"), F.lit("hidden").alias("answer"), ((F.col("doc_id") + F.col("group_no")) % 2 == 0).alias("teacher_approved"))
    packs = V.questions(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_no", item.alias("i")))), lambda s: s["i"]).alias("items"))
    shown = F.array_join(F.transform("items", lambda i: F.concat(i["question_id"], F.lit("="), F.sha2(i["text"], 256))), ",")
    return governance.student_safe(packs).select("doc_id", F.size("items").cast("long").alias("n_items"), shown.alias("items"))


@query(S.cte(S.LINES) + """, b AS (SELECT doc_id, page_number, seq, text, CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 1.2 END AS x1, y1 FROM lines)
SELECT doc_id, seq, CASE WHEN doc_id % 2 = 0 THEN round(0.1, 7) END AS left_, CASE WHEN doc_id % 2 = 0 THEN round(least(1.0, y1 + 0.02), 7) END AS bottom FROM b""")
def boxes_normalised(spark, sf):
    top = F.get("normalized_bbox", F.lit(1))
    polygon = F.array(*[x * 1000 for x in (F.lit(0.9), top, F.lit(0.1), top, F.lit(0.1), top + 0.02, F.lit(0.9), top + 0.02)])
    box = G.normalised(F.when(F.col("doc_id") % 2 == 0, polygon).otherwise(F.array(F.lit(1.0))), F.lit(1000), F.lit(1000))
    return V.lines(spark, sf).select("doc_id", F.col("seq").cast("long").alias("seq"), F.get(box, F.lit(0)).alias("left_"), F.get(box, F.lit(3)).alias("bottom"))


@query(S.cte(S.LINES) + """, b AS (SELECT doc_id, seq, seq % 4 AS t, 100.0::DOUBLE AS x1, y1 * 1000 AS y1, 900.0::DOUBLE AS x2, y2 * 1000 AS y2 FROM lines)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, round(CASE t WHEN 0 THEN x1 WHEN 1 THEN 1000 - y2 WHEN 2 THEN 1000 - x2 ELSE y1 END, 6) AS left_, round(CASE t WHEN 0 THEN y2 WHEN 1 THEN x2 WHEN 2 THEN 1000 - y1 ELSE 1000 - x1 END, 6) AS bottom FROM b""")
def boxes_turned(spark, sf):
    y1, y2 = (F.get("normalized_bbox", F.lit(i)) * 1000 for i in (1, 3))
    # found at twice the scale on a page turned by so many quarters
    box = G.turned_back(F.array(F.lit(200.0), y1 * 2, F.lit(1800.0), y2 * 2), F.col("seq") % 4, F.lit(1000.0), F.lit(1000.0), F.lit(2.0))
    return V.lines(spark, sf).select("doc_id", F.col("seq").cast("long").alias("seq"), F.round(F.get(box, F.lit(0)), 6).alias("left_"), F.round(F.get(box, F.lit(3)), 6).alias("bottom"))


@query(REVIEWS + """, h AS (SELECT item_id, sha256(CAST(item_id AS VARCHAR)) AS d, sha256(text) AS c FROM s JOIN documents ON doc_id = item_id WHERE state = 'gold'),
n AS (SELECT *, (6 * list_sum(list_transform(range(1, 64), lambda i: strpos('0123456789abcdef', d[i:i]) - 1)) + strpos('0123456789abcdef', d[64:64]) - 1) % 10 AS m FROM h),
e AS (SELECT CASE m WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, item_id, c FROM n), x AS (SELECT split, sha256(item_id || chr(0) || c || chr(0) || split) AS e FROM e),
g AS (SELECT substr(e, 1, 3) AS g, sha256(string_agg(e, chr(10) ORDER BY e)) AS h FROM x GROUP BY 1), top AS (SELECT sha256(string_agg(h, chr(10) ORDER BY g)) AS h FROM g)
SELECT count(*) AS item_count, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation, count(*) FILTER (split = 'test') AS n_test, count(*) > 0 AS releasable, (SELECT h FROM top) AS manifest_sha256 FROM x""")
def release_of_gold(spark, sf):
    made = datasets.release_manifest(_release_items(spark, sf).filter("state = 'gold'"))
    return made.select("item_count", "n_train", "n_validation", "n_test", "releasable", "manifest_sha256")


@query(S.cte(S.LINES, S.ELEMENTS) + COVERAGE + """, r AS (SELECT doc_id, line_id, CASE WHEN disposition = 'prose' AND (SELECT seq FROM lines l WHERE l.line_id = d.line_id) % 4 = 1 THEN 'user_removed' ELSE disposition END AS disposition FROM d)
SELECT doc_id, count(*) AS raw_line_count, count(*) FILTER (disposition = 'user_removed') AS n_user_removed, count(*) FILTER (disposition = 'prose') AS n_prose, round((count(*) - count(*) FILTER (disposition = 'unresolved')) * 100.0 / count(*), 2)::DOUBLE AS coverage_percent FROM r GROUP BY doc_id""")
def coverage_after_removal(spark, sf):
    found = _dispositions(spark, sf)
    removed = V.lines(spark, sf).filter("seq % 4 = 1").select("doc_id", "line_id").join(found.filter("disposition = 'prose'").select("doc_id", "line_id"), ["doc_id", "line_id"], "left_semi")
    return reconcile.content_coverage(reconcile.remove_lines(found, removed)).select("doc_id", "raw_line_count", "n_user_removed", "n_prose", F.col("coverage_percent").cast("double").alias("coverage_percent"))


@query(S.cte(S.RESOURCES) + """SELECT resource_id, status FROM resources WHERE resource_type = 'dataset_item' AND status = 'completed' AND course_id = 'BUILDING' AND updated_at >= TIMESTAMP '1993-01-01' AND updated_at <= TIMESTAMP '1998-01-01' AND resource_id % 4 = 2
AND resource_id % 3 = 1 AND resource_id % 10 <= 6 AND contains(lower(created_by), 'customer')""")
def search_filters(spark, sf):
    """Every predicate but the words' own place, at once."""
    k = F.col("resource_id")
    payload = F.to_json(F.struct((k % 4).cast("string").alias("assessment_id"), F.when(k % 3 == 1, "en").otherwise("de").alias("language"), (k % 100).alias("quality_score"), (k % 10).alias("warning_count")))
    r = V.resources(spark, sf).withColumns({"payload": payload, "created_at": F.col("updated_at"), "title": F.col("created_by"), "search_text": F.lit("")})
    found = governance.search_lexical(r, "CUSTOMER", resource_type="dataset_item", status="completed", course_id="BUILDING", assessment_id="2", created_from=datetime(1993, 1, 1), created_to=datetime(1998, 1, 1), quality_min=0, warning_max=6, language="en")
    return found.select("resource_id", "status")


@query(S.cte(S.LINES) + """, g AS (SELECT DISTINCT doc_id, page_number AS table_index FROM lines)
SELECT doc_id, CAST(table_index AS INTEGER) AS table_index, round(round(0.20 * (doc_id % 7) / 10 + 0.25 * (doc_id % 10) / 10 + 0.15 * (doc_id % 9) / 10 + 0.10 * (doc_id % 8) / 10 + 0.10 * (doc_id % 2) + 0.10 * (doc_id % 4) / 10 + 0.05 * (doc_id % 3) / 10 + 0.05, 4), 3) AS quality FROM g""")
def table_blend(spark, sf):
    """The eight-term blend over stated components."""
    tenth = lambda n: F.col("doc_id") % n / 10
    parts = {"source_coverage": tenth(10), "text_agreement": tenth(9), "table_token_coverage": tenth(8), "orientation": (F.col("doc_id") % 2).cast("double"), "bbox_identity": tenth(4), "plausibility": tenth(3)}
    return V.cells(spark, sf).select("doc_id", "table_index").distinct().select("doc_id", "table_index", F.round(reconcile.table_quality(tenth(7), parts), 3).alias("quality"))

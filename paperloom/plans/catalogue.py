"""The library's queries by name, each over whole tables, and the SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import geometry as G
from paperloom.functions import keys as K
from paperloom.functions import text as X
from paperloom.operators import curriculum, datasets, governance, jobs, overlays, reconcile, reports, segment, similarity
from paperloom.plans import sql as S
from paperloom.plans import views as V
from paperloom.sources import readers
from paperloom.sources.staging import new_folder, staged
from paperloom.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _listed(c: str | Column) -> Column:
    return F.array_join(c, ",")


NOW = datetime(1999, 1, 1)
CUTOFF = datetime(1997, 1, 1)


@query(S.cte(S.QUESTIONS) + "SELECT doc_id, group_no, question_id, display_number, sha256(text) AS text_hash, source_page, line_ids, top, bottom, ocr_confidence, marks, marks_status FROM questions")
def segment_questions(spark, sf):
    q = segment.segment_questions(V.lines(spark, sf))
    return q.select("doc_id", "group_no", "question_id", "display_number", F.sha2("text", 256).alias("text_hash"), "source_page", _listed("source_line_ids").alias("line_ids"), F.get("source_bbox", F.lit(1)).alias("top"), F.get("source_bbox", F.lit(3)).alias("bottom"), "ocr_confidence", "marks", "marks_status")


@query(S.cte(S.QUESTIONS) + """SELECT doc_id, topic, count(*) AS question_count, CAST(sum(coalesce(marks, 0)) AS BIGINT) AS marks_total, count(*) FILTER (difficulty = 'low') AS n_low, count(*) FILTER (difficulty = 'medium') AS n_medium,
  count(*) FILTER (difficulty = 'high') AS n_high, string_agg(question_id, ',' ORDER BY question_id) AS ids, topic <> 'Unclassified' AS priority,
  CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS document_questions, CAST(sum(sum(coalesce(marks, 0))) OVER (PARTITION BY doc_id) AS BIGINT) AS document_marks FROM questions GROUP BY doc_id, topic""")
def paper_analysis(spark, sf):
    return reports.paper_analysis(V.questions(spark, sf)).select("doc_id", "topic", "question_count", "marks_total", "n_low", "n_medium", "n_high", _listed("question_ids").alias("ids"), "priority", "document_questions", "document_marks")


@query(S.cte(S.QUESTIONS) + "SELECT topic, count(*) AS occurrences, count(DISTINCT doc_id) AS papers FROM questions GROUP BY topic HAVING count(*) > 1")
def recurring_topics(spark, sf):
    return reports.recurring_topics(V.questions(spark, sf))


@query(S.cte(S.QUESTIONS, S.CORRECTIONS, S.MAPPINGS) + """, per AS (SELECT doc_id, count(*) AS question_count, CAST(sum(coalesce(marks, 0)) AS BIGINT) AS marks_total, count(*) FILTER (ocr_confidence < 0.7) AS low_confidence, count(*) FILTER (topic IS NULL) AS unmapped FROM questions GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n FROM mappings WHERE status = 'approved' GROUP BY doc_id), p AS (SELECT doc_id, count(*) AS n FROM corrections WHERE status IN ('draft', 'reviewed') GROUP BY doc_id)
SELECT per.*, coalesce(a.n, 0) AS approved_mappings, coalesce(p.n, 0) AS pending_corrections, round(o_totalprice / 500000, 6) AS quality_score, o_orderkey % 5 AS warning_count
FROM per LEFT JOIN a USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN orders ON o_orderkey = doc_id""")
def compare_papers(spark, sf):
    q = staged(V.questions(spark, sf))
    j = V.jobs(spark, sf).withColumnRenamed("job_id", "doc_id")
    return reports.compare_papers(q, V.corrections(spark, sf), V.mappings(q), j).withColumn("quality_score", F.round("quality_score", 6))


@query(S.cte(S.QUESTIONS) + """SELECT 'topic' AS field, topic AS value, count(*) AS question_count FROM questions GROUP BY topic UNION ALL SELECT 'difficulty', difficulty, count(*) FROM questions GROUP BY difficulty
UNION ALL SELECT 'marks_status', marks_status, count(*) FROM questions GROUP BY marks_status""")
def question_distributions(spark, sf):
    return reports.distributions(V.questions(spark, sf), ("topic", "difficulty", "marks_status"))


NORMAL = "array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\pL\\pN]+'), ' ')"


@query(f"""WITH n AS (SELECT doc_id, {NORMAL} AS normal FROM documents), h AS (SELECT doc_id AS question_key, sha256(normal) AS norm_hash FROM n WHERE normal <> ''),
c AS (SELECT norm_hash, min(question_key) AS class_key, count(*) AS class_size FROM h GROUP BY norm_hash HAVING count(*) > 1) SELECT question_key, norm_hash, class_key, class_size FROM h JOIN c USING (norm_hash)""")
def duplicates_exact(spark, sf):
    return similarity.exact_duplicates(V.table(spark, sf, "documents").select(F.col("doc_id").alias("question_key"), "text")).select("question_key", "norm_hash", "class_key", "class_size")


def _near(source: str, threshold: float) -> str:
    """All pairs of distinct normalised texts by their shared word triples, and each copy with its representative."""
    return f"""WITH n AS ({source}), d AS (SELECT min(k) AS k, normal FROM n GROUP BY normal), w AS (SELECT k, string_split(normal, ' ') AS w FROM d WHERE normal <> ''),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM w),
z AS (SELECT k, count(*) AS n FROM s GROUP BY k), p AS (SELECT a.k AS left_key, b.k AS right_key, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
near AS (SELECT left_key, right_key, round(c / (x.n + y.n - c), 4) AS score, 'token_shingle' AS method FROM p JOIN z x ON x.k = left_key JOIN z y ON y.k = right_key WHERE c / (x.n + y.n - c) >= {threshold}),
exact AS (SELECT d.k AS left_key, n.k AS right_key, 1.0::DOUBLE AS score, 'exact_fingerprint' AS method FROM n JOIN d USING (normal) WHERE n.k <> d.k AND normal <> '') SELECT * FROM near UNION ALL SELECT * FROM exact"""


@query(_near(f"SELECT conv_id * 1000 + turn AS k, {NORMAL} AS normal FROM conversations", 0.55))
def duplicates_near(spark, sf):
    turns = V.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_key"), "text")
    return similarity.duplicate_pairs(turns)


@query(_near(f"SELECT item_id AS k, {NORMAL} AS normal FROM benchmark UNION ALL SELECT item_id + 1000000, {NORMAL.replace('text', 'text || chr(32) || chr(97) || chr(32) || item_id')} FROM benchmark", 0.55))
def near_questions(spark, sf):
    """Each question and a version with two words more."""
    b = V.table(spark, sf, "benchmark")
    more = b.select((F.col("item_id") + 1000000).alias("question_key"), F.concat("text", F.lit(" a "), F.col("item_id").cast("string")).alias("text"))
    return similarity.duplicate_pairs(b.select(F.col("item_id").alias("question_key"), "text").union(more))


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY score DESC, left_key, right_key) AS INTEGER) AS rank FROM ({_near(f'SELECT doc_id AS k, {NORMAL} AS normal FROM documents', 0.55)}) ORDER BY rank LIMIT 100")
def duplicates_ranked(spark, sf):
    """The hundred pairs that are most alike: a report, whose limit is its use."""
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("question_key"), "text")
    return similarity.ranked_pairs(similarity.duplicate_pairs(docs, 0.55), 100)


@query(_near(f"SELECT doc_id AS k, {NORMAL} AS normal FROM documents", 0.55))
def duplicate_documents(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("question_key"), "text")
    return similarity.duplicate_pairs(docs, 0.55)


EFFECTIVE = """, e AS (SELECT l.doc_id, l.seq, l.line_id, l.page_number, l.text AS raw_text, coalesce(c.replacement, l.text) AS text, c.correction_id IS NOT NULL AS corrected, c.correction_id, round(l.confidence, 4) AS confidence,
  CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'review' ELSE 'low' END AS confidence_band FROM lines l LEFT JOIN (SELECT * FROM corrections WHERE status = 'approved' AND NOT stale) c ON c.doc_id = l.doc_id AND c.target_id = l.line_id)
"""


@query(S.cte(S.LINES, S.CORRECTIONS) + EFFECTIVE + "SELECT doc_id, line_id, sha256(raw_text) AS raw_hash, sha256(text) AS text_hash, corrected, correction_id, confidence, confidence_band FROM e")
def effective_lines(spark, sf):
    return _effective(spark, sf).select("doc_id", "line_id", F.sha2("raw_text", 256).alias("raw_hash"), F.sha2("text", 256).alias("text_hash"), "corrected", "correction_id", "confidence", "confidence_band")


def _effective(spark, sf):
    return overlays.effective_lines(V.lines(spark, sf), overlays.mark_stale(V.corrections(spark, sf), V.evidence(spark, sf)))


@query(S.cte(S.LINES, S.CORRECTIONS) + EFFECTIVE + "SELECT doc_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (trim(text) <> ''), '')) AS text_hash FROM e GROUP BY doc_id")
def reconstructed_text(spark, sf):
    c = overlays.mark_stale(V.corrections(spark, sf), V.evidence(spark, sf))
    return overlays.reconstructed_text(overlays.effective_lines(V.lines(spark, sf), c), c).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(S.cte(S.QUESTIONS) + """SELECT doc_id, question_id, sha256(CASE WHEN (doc_id + group_no) % 5 = 0 THEN 'Question ' || display_number ELSE text END) AS text_hash,
  CAST(CASE WHEN (doc_id + group_no) % 3 = 0 AND (doc_id + group_no) % 120 <= 100 THEN (doc_id + group_no) % 120 ELSE marks END AS INTEGER) AS marks,
  CASE WHEN (doc_id + group_no) % 3 = 0 AND (doc_id + group_no) % 120 <= 100 THEN 'teacher_approved_overlay' ELSE marks_status END AS marks_status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question_id ORDER BY group_no) AS rn FROM questions)""")
def effective_questions(spark, sf):
    q = V.questions(spark, sf)
    return overlays.effective_questions(q, V.question_corrections(q)).select("doc_id", "question_id", F.sha2("text", 256).alias("text_hash"), "marks", "marks_status")


@query(S.cte(S.LINES, S.CORRECTIONS) + "SELECT doc_id, correction_id, stale FROM corrections")
def mark_stale(spark, sf):
    return overlays.mark_stale(V.corrections(spark, sf), V.evidence(spark, sf)).select("doc_id", "correction_id", "stale")


@query(S.cte(S.QUESTIONS, S.MAPPINGS) + """, m AS (SELECT DISTINCT doc_id, question_id FROM mappings WHERE status = 'approved'),
ql AS (SELECT q.doc_id, unnest(string_split(q.line_ids, ',')) AS line_id, q.marks, m.question_id IS NULL AS un FROM questions q LEFT JOIN m ON m.doc_id = q.doc_id AND m.question_id = q.question_id),
g AS (SELECT doc_id, line_id, bool_or(marks IS NOT NULL) AS hm, bool_or(un) AS un FROM ql GROUP BY ALL)
SELECT l.doc_id, l.line_id, array_to_string(list_sort(list_filter(['text', CASE WHEN g.line_id IS NOT NULL THEN 'question' END, CASE WHEN hm THEN 'marks' END, CASE WHEN un THEN 'unmapped' END], lambda x: x IS NOT NULL)), ',') AS evidence_types FROM lines l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line_id = l.line_id""")
def evidence_types(spark, sf):
    q = staged(V.questions(spark, sf))
    return overlays.evidence_types(V.lines(spark, sf), q, V.mappings(q)).select("doc_id", "line_id", _listed("evidence_types").alias("evidence_types"))


@query(S.cte(S.LINES, S.CORRECTIONS) + EFFECTIVE + "SELECT doc_id, 'issue-' || line_id AS issue_id, line_id, page_number, confidence, confidence_band, CASE WHEN corrected THEN 'approved' ELSE 'uncorrected' END AS correction_status, true AS geometry_available FROM e WHERE confidence < 0.9 OR corrected")
def review_issues(spark, sf):
    return overlays.review_issues(_effective(spark, sf)).drop("text")


@query(S.cte(S.QUESTIONS, S.MAPPINGS) + "SELECT doc_id, question_id, group_no FROM questions WHERE (doc_id, question_id) NOT IN (SELECT doc_id, question_id FROM mappings WHERE status = 'approved')")
def unmapped_questions(spark, sf):
    q = staged(V.questions(spark, sf))
    return overlays.unmapped_questions(q, V.mappings(q)).select("doc_id", "question_id", "group_no")


@query(S.cte(S.QUESTIONS, S.CORRECTIONS, S.MAPPINGS, S.JOBS) + """SELECT (SELECT count(*) FROM corrections WHERE status IN ('draft', 'reviewed')) AS pending_corrections, (SELECT count(*) FROM jobs WHERE quality_score < 0.70) AS low_quality_jobs,
(SELECT count(*) FROM questions WHERE (doc_id + group_no) % 4 = 1) AS bank_pending, (SELECT count(*) FROM questions WHERE (doc_id + group_no) % 4 = 2) AS bank_approved, (SELECT count(*) FROM jobs WHERE status = 'queued') AS active_batches,
greatest(0, (SELECT count(*) FROM questions) - (SELECT count(*) FROM (SELECT DISTINCT doc_id, question_id FROM mappings WHERE status = 'approved'))) AS unmapped_questions""")
def dashboard_counts(spark, sf):
    q = staged(V.questions(spark, sf))
    key = (F.col("doc_id") + F.col("group_no")) % 4
    bank = q.select(F.when(key == 1, "draft").when(key == 2, "approved").otherwise("rejected").alias("status"))
    return reports.dashboard_counts(V.corrections(spark, sf), V.jobs(spark, sf), bank, V.jobs(spark, sf), q, V.mappings(q).filter("status = 'approved'"))


@query("SELECT user_id, event_id AS version, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_version(spark, sf):
    rows = V.table(spark, sf, "events").select("user_id", F.col("event_id").alias("version"), "event_type")
    return overlays.latest_version(rows, "user_id")


@query("""WITH v AS (SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'published' ELSE 'draft' END AS status FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, max(CASE WHEN status = 'published' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM v)
SELECT user_id, event_id, status, CAST(version AS INTEGER) AS version, CASE WHEN status = 'published' AND coalesce(later, 0) = 1 THEN 'superseded' ELSE status END AS effective_status FROM w""")
def next_version(spark, sf):
    rows = V.table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("purchase", "signup"), "published").otherwise("draft").alias("status"))
    return overlays.next_version(rows, "user_id", "event_id")


STATUS = "CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'in_review' WHEN 'signup' THEN 'changes_requested' WHEN 'purchase' THEN 'approved' ELSE 'rejected' END"


@query(f"""WITH e AS (SELECT user_id, event_id, {STATUS} AS to_status FROM events), s AS (SELECT *, lag(to_status) OVER (PARTITION BY user_id ORDER BY event_id) AS from_status FROM e)
SELECT user_id, event_id, from_status, to_status FROM s WHERE from_status IS NOT NULL AND from_status <> to_status AND (from_status, to_status) NOT IN (VALUES ('open', 'in_review'), ('open', 'cancelled'), ('in_review', 'approved'), ('in_review', 'changes_requested'), ('in_review', 'rejected'), ('in_review', 'cancelled'), ('changes_requested', 'in_review'), ('changes_requested', 'cancelled'))""")
def transition_violations(spark, sf):
    rows = V.table(spark, sf, "events").select("user_id", "event_id", F.expr(STATUS).alias("status"))
    return overlays.check_transitions(rows, governance.transitions_of(spark, "review_task"), "user_id", "event_id").select("user_id", "event_id", "from_status", "to_status")


@query("""WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS version FROM events), w AS (SELECT *, coalesce(lag(version) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS current_version FROM v)
SELECT user_id, event_id, version, current_version FROM w WHERE version <> current_version + 1""")
def version_conflicts(spark, sf):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = V.table(spark, sf, "events").select("user_id", "event_id", (number + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).cast("long").alias("version"))
    return overlays.version_conflicts(rows, "user_id", "event_id")


@query(S.cte(S.JOBS) + "SELECT job_id, input_name, workflow, status, created_at FROM jobs WHERE lower(input_name) LIKE '%paper\\_1%' ESCAPE '\\' AND workflow = 'text_recognition' AND status = 'completed' AND created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-01-01' AND NOT pinned")
def filter_jobs(spark, sf):
    found = jobs.filter_jobs(V.jobs(spark, sf), "paper_1", "text_recognition", "completed", datetime(1995, 1, 1), datetime(1999, 1, 1), False)
    return found.select("job_id", "input_name", "workflow", "status", "created_at")


@query(S.cte(S.JOBS) + "SELECT job_id, status, CASE WHEN status = 'completed' THEN job_id % 100 * 1000 END AS duration_ms, status = 'completed' AS result_available, false AS analysis_available FROM jobs")
def job_summary(spark, sf):
    return jobs.job_summary(V.jobs(spark, sf)).select("job_id", "status", "duration_ms", "result_available", "analysis_available")


@query(S.cte(S.JOBS) + "SELECT job_id, updated_at FROM jobs WHERE updated_at < TIMESTAMP '1998-06-01' OR (updated_at = TIMESTAMP '1998-06-01' AND job_id < 5000) ORDER BY updated_at DESC, job_id DESC LIMIT 51")
def job_page_keyset(spark, sf):
    return jobs.keyset_page(V.jobs(spark, sf).select("job_id", "updated_at"), 50, (datetime(1998, 6, 1), 5000), ("updated_at", "job_id"))


@query(S.cte(S.JOBS) + ", r AS (SELECT job_id, updated_at, row_number() OVER (ORDER BY updated_at DESC, job_id DESC) AS place FROM jobs) SELECT job_id, updated_at, CAST((place - 1) // 40 AS INTEGER) AS page FROM r WHERE place <= 120")
def job_pages_by_cursor(spark, sf):
    """Three pages, each found by the cursor that the one before gave."""
    rows, cursor, pages = V.jobs(spark, sf).select("job_id", "updated_at"), None, []
    for page in range(3):
        found, cursor = jobs.cursor_page(rows, 40, cursor, ("updated_at", "job_id"))
        pages += [(r["job_id"], r["updated_at"], page) for r in found]
    return spark.createDataFrame(pages, T.StructType([*rows.schema.fields, T.StructField("page", T.IntegerType())]))


@query(S.cte(S.JOBS) + "SELECT job_id, pinned, round(quality_score, 6) AS quality_score FROM jobs ORDER BY pinned DESC, jobs.quality_score DESC, job_id LIMIT 100 OFFSET 20")
def job_list(spark, sf):
    return jobs.job_list(V.jobs(spark, sf), "quality", 100, 20).select("job_id", "pinned", F.round("quality_score", 6).alias("quality_score"))


@query("SELECT doc_id, source FROM documents WHERE (contains(lower(source), 'the') OR contains(replace(lower(text), 'ß', 'ss'), 'the')) AND (contains(lower(source), 'license') OR contains(replace(lower(text), 'ß', 'ss'), 'license')) AND n_chars >= 100")
def search_lexical(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", "source", F.col("source").alias("title"), F.col("text").alias("search_text"), F.to_json(F.struct(F.col("n_chars").alias("quality_score"))).alias("payload"))
    return governance.search_lexical(rows, "The LICENSE", quality_min=100).select("doc_id", "source")


@query()
def search_semantic(spark, sf):
    queries = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return similarity.search_semantic(V.table(spark, sf, "documents"), queries, 10)


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk(spark, sf):
    vectors = V.table(spark, sf, "embeddings")
    first = vectors.filter("vec_id = 0").select("embedding").first()
    if first is None:
        return vectors.limit(0).select("vec_id", F.lit(0.0).alias("score"))
    return similarity.vector_topk(vectors, [float(x) for x in first["embedding"]], 20)


@query(S.cte(S.RESOURCES) + "SELECT course_id, resource_type, count(*) AS n FROM resources WHERE tenant_id = 'NATION_3' AND (visibility <> 'private' OR created_by = 'Customer#000000007') AND course_id IN ('BUILDING', 'MACHINERY') AND (resource_type <> 'student_progress' OR created_by = 'Customer#000000007') GROUP BY ALL")
def scope_counts(spark, sf):
    seen = governance.apply_scope(V.resources(spark, sf), "NATION_3", "Customer#000000007", ("BUILDING", "MACHINERY"), student=True)
    return seen.groupBy("course_id", "resource_type").agg(F.count("*").alias("n"))


@query(S.cte(S.RESOURCES) + "SELECT created_by AS subject, count(*) AS n FROM (SELECT c.c_name AS created_by FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN resources r ON r.tenant_id = n_name WHERE (r.visibility <> 'private' OR r.created_by = c.c_name) AND r.course_id = c.c_mktsegment) GROUP BY created_by")
def scope_many(spark, sf):
    c, n = V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    who = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("subject"), F.col("n_name").alias("tenant_id"), F.array("c_mktsegment").alias("courses"))
    return governance.scope_counts(V.resources(spark, sf), who)


@query(S.cte(S.RESOURCES) + "SELECT * FROM (SELECT CASE WHEN status = 'draft' THEN 'drafts' WHEN status = 'archived' THEN 'archived' ELSE 'completed' END AS queue, count(*) AS n FROM resources GROUP BY ALL)")
def queue_counts(spark, sf):
    conditions = {"drafts": F.col("status") == "draft", "archived": F.col("status") == "archived", "completed": F.col("status") == "completed"}
    one = reports.queue_counts(V.resources(spark, sf), conditions)
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, conditions)), F.array(*conditions)))).select(F.col("key").alias("queue"), F.col("value").alias("n"))


@query("""WITH s AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]{3,}'))) AS w FROM benchmark), o AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z0-9]{3,}'))) AS w FROM documents),
a AS (SELECT item_id, count(*) AS a FROM s GROUP BY 1), b AS (SELECT doc_id, count(*) AS b FROM o GROUP BY 1), p AS (SELECT item_id, doc_id, count(*) AS k FROM s JOIN o USING (w) GROUP BY ALL),
r AS (SELECT item_id AS source_id, doc_id AS objective_id, k / (a + b - k) AS raw, row_number() OVER (PARTITION BY item_id ORDER BY k / (a + b - k) DESC, doc_id) AS rank FROM p JOIN a USING (item_id) JOIN b USING (doc_id))
SELECT source_id, objective_id, round(raw, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def suggest_mappings(spark, sf):
    s = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("source_id"), "text")
    o = V.table(spark, sf, "documents").select(F.col("doc_id").alias("objective_id"), "text")
    return similarity.suggest_mappings(s, o, 5).select("source_id", "objective_id", "score", "rank")


@query("SELECT p_partkey AS objective_id, count(l_partkey) AS mapping_count, count(l_partkey) > 0 AS mapped FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) ON l_partkey = p_partkey GROUP BY 1")
def objective_coverage(spark, sf):
    m = V.table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("objective_id"), F.lit("draft").alias("status"))
    return curriculum.objective_coverage(V.table(spark, sf, "part").select(F.col("p_partkey").alias("objective_id")), m)


PART_CODES = "SELECT p_partkey AS row, 'P-' || p_partkey AS code, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'P-' || (p_partkey * 2) END AS parent FROM part"


@query(f"WITH o AS ({PART_CODES}) SELECT row, 'parent' AS kind, parent AS reference FROM o WHERE parent IS NOT NULL AND parent NOT IN (SELECT code FROM o)")
def broken_references(spark, sf):
    k = F.col("p_partkey")
    o = V.table(spark, sf, "part").select(k.alias("row"), F.concat(F.lit("P-"), k.cast("string")).alias("stable_code"), F.when(k % 10 != 0, F.concat(F.lit("P-"), (k * 2).cast("string"))).alias("parent_code"), F.array().cast("array<string>").alias("prerequisites"), F.array().cast("array<string>").alias("replaces"))
    return curriculum.check_references(o)


@query("""WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 100 = 0 THEN NULL WHEN c_custkey % 100 = 7 THEN 900000000 WHEN c_custkey % 100 = 9 THEN c_custkey ELSE c_custkey - c_custkey % 10 - CASE WHEN c_custkey % 10 = 0 THEN 10 ELSE 0 END END AS parent FROM customer),
w AS (SELECT id FROM t WHERE parent IS NULL UNION SELECT t.id FROM t JOIN w ON t.parent = w.id), lost AS (SELECT id FROM t WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM t))
SELECT id AS node_id, 'unknown_parent' AS rule FROM lost UNION ALL SELECT id, 'cycle' FROM t WHERE id NOT IN (SELECT id FROM w) AND id NOT IN (SELECT id FROM lost)""")
def tree_check(spark, sf):
    k = F.col("c_custkey")
    parent = F.when(k % 100 == 0, None).when(k % 100 == 7, F.lit(900000000).cast("long")).when(k % 100 == 9, k).otherwise(k - k % 10 - F.when(k % 10 == 0, 10).otherwise(0))
    return curriculum.tree_check(V.table(spark, sf, "customer").select(k.alias("node_id"), parent.alias("parent_id")))


@query(S.cte(S.RESOURCES) + "SELECT resource_id, resource_type, status, updated_at FROM resources WHERE resource_type IN ('worker_job', 'answer_script', 'dataset_item') AND status IN ('completed', 'archived') AND updated_at < TIMESTAMP '1997-01-01' AND NOT held")
def retention_candidates(spark, sf):
    return governance.retention_candidates(V.resources(spark, sf), CUTOFF).select("resource_id", "resource_type", "status", "updated_at")


@query(S.cte(S.RESOURCES) + """, g AS (SELECT * FROM resources WHERE resource_type IN ('worker_job', 'answer_script', 'dataset_item') AND status IN ('completed', 'archived') AND updated_at < TIMESTAMP '1997-01-01' AND NOT held)
SELECT 'kept' AS part, CAST(resource_id AS VARCHAR) AS id FROM resources WHERE resource_id NOT IN (SELECT resource_id FROM g) UNION ALL SELECT 'audit', CAST(resource_id AS VARCHAR) FROM g UNION ALL SELECT 'object', tenant_id || '/' || resource_id FROM g WHERE tenant_id = 'NATION_4'""")
def retention_apply(spark, sf):
    r = V.resources(spark, sf)
    kept, audit, objects = governance.retention_apply(r, governance.retention_candidates(r, CUTOFF), "NATION_4")
    part = lambda df, name, c: df.select(F.lit(name).alias("part"), F.col(c).cast("string").alias("id"))
    return part(kept, "kept", "resource_id").union(part(audit, "audit", "resource_id")).union(part(objects, "object", "object_key"))


@query(S.cte(S.JOBS) + "SELECT status, count(*) AS n FROM jobs WHERE status IN ('completed', 'failed') AND updated_at < TIMESTAMP '1997-01-01' AND NOT pinned GROUP BY status")
def expire_terminal_jobs(spark, sf):
    return jobs.expire_terminal_jobs(V.jobs(spark, sf), CUTOFF)[1].groupBy("status").agg(F.count("*").alias("n"))


STATE = "CASE WHEN verified >= 2 THEN 'gold' WHEN verified = 1 THEN 'silver' WHEN rejected > 0 THEN 'rejected' ELSE 'unlabelled' END"
REVIEWS = f"""WITH r AS (SELECT doc_id, CAST(quality = 1 AS INTEGER) + CAST(toxic = 0 AS INTEGER) AS verified, CAST(quality = 0 AS INTEGER) + CAST(toxic = 1 AS INTEGER) AS rejected FROM labels), s AS (SELECT doc_id AS item_id, CAST(verified AS BIGINT) AS verified, CAST(rejected AS BIGINT) AS rejected, {STATE} AS state FROM r)
"""


def _reviews(spark, sf):
    say = lambda good: F.when(good, "verified").otherwise("rejected")
    both = F.explode(F.array(F.struct(F.lit("A").alias("reviewer"), say(F.col("quality") == 1).alias("decision")), F.struct(F.lit("B").alias("reviewer"), say(F.col("toxic") == 0).alias("decision")))).alias("r")
    return V.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), both).select("item_id", "r.*", F.lit(1).alias("seq"))


@query(REVIEWS + "SELECT * FROM s")
def label_state(spark, sf):
    return datasets.label_state(_reviews(spark, sf))


@query(REVIEWS + """, h AS (SELECT item_id, sha256(CAST(item_id AS VARCHAR)) AS d FROM s WHERE state = 'gold'),
n AS (SELECT item_id, (6 * list_sum(list_transform(range(1, 64), lambda i: strpos('0123456789abcdef', d[i:i]) - 1)) + strpos('0123456789abcdef', d[64:64]) - 1) % 10 AS m FROM h)
SELECT item_id, item_id AS source_document_id, sha256(text) AS content_sha256, CASE m WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM n JOIN documents ON doc_id = item_id""")
def dataset_release(spark, sf):
    return datasets.dataset_release(_release_items(spark, sf))


def _release_items(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("source_document_id"), F.sha2("text", 256).alias("content_sha256"))
    return datasets.label_state(_reviews(spark, sf)).join(docs, "item_id")


@query(REVIEWS + "SELECT count(*) AS item_count, count(*) FILTER (state <> 'gold') AS not_gold, false AS releasable FROM s JOIN documents ON doc_id = item_id")
def release_manifest(spark, sf):
    return datasets.release_manifest(_release_items(spark, sf)).select("item_count", "not_gold", "releasable")


@query(S.cte(S.AUDIT) + "SELECT tenant, sequence, previous_hash, expected_previous FROM (SELECT *, lag(event_hash) OVER (PARTITION BY tenant ORDER BY sequence) AS expected_previous FROM audit) WHERE previous_hash IS DISTINCT FROM expected_previous")
def audit_verify(spark, sf):
    return governance.verify_audit_chain(V.audit(spark, sf)).select("tenant", "sequence", "previous_hash", "expected_previous")


@query("""WITH RECURSIVE e AS (SELECT user_id % 10 AS tenant, event_id AS sequence, event_type || '|' || props AS body, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events),
c AS (SELECT tenant, n, sequence, body, CAST(NULL AS VARCHAR) AS previous_hash, sha256(body) AS event_hash FROM e WHERE n = 1 UNION ALL SELECT e.tenant, e.n, e.sequence, e.body, c.event_hash, sha256(c.event_hash || e.body) FROM c JOIN e ON e.tenant = c.tenant AND e.n = c.n + 1)
SELECT tenant, sequence, body, previous_hash, event_hash FROM c""")
def audit_chain(spark, sf):
    e = V.table(spark, sf, "events").select((F.col("user_id") % 10).alias("tenant"), F.col("event_id").alias("sequence"), F.concat_ws("|", "event_type", "props").alias("body"))
    return governance.chain_audit(e)


@query(S.pseudonyms(b"not a secret: the key is an option"))
def pseudonyms(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", K.pseudonym(b"not a secret: the key is an option", F.col("c_nationkey").cast("string"), "c_name").alias("pseudonym"))


QUALITY = """, w AS (SELECT DISTINCT doc_id, page_number, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z]{3,}')) AS token FROM lines), f AS (SELECT token, ln(count(*)) / ln(10) AS zipf FROM w GROUP BY token),
o AS (SELECT doc_id, page_number, avg(CASE WHEN zipf < 0.5 THEN 1.0 ELSE 0.0 END) AS odd FROM w JOIN f USING (token) GROUP BY ALL),
p AS (SELECT doc_id, page_number, avg(confidence) AS m, avg(CASE WHEN confidence < 0.90 THEN 1.0 ELSE 0.0 END) AS low, avg(CASE WHEN regexp_matches(text, '[A-Za-z]{12,}') THEN 1.0 ELSE 0.0 END) AS fused FROM lines GROUP BY ALL)
SELECT doc_id, page_number, round(round(0.58 * m + 0.17 * (1 - low) + 0.15 * (1 - coalesce(odd, 0)) + 0.10 * (1 - fused), 4), 3) AS quality, array_to_string(list_filter([CASE WHEN low >= 0.12 THEN 'low_confidence_density' END, CASE WHEN coalesce(odd, 0) >= 0.12 THEN 'improbable_token_density' END, CASE WHEN fused >= 0.04 THEN 'fused_word_density' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p LEFT JOIN o USING (doc_id, page_number)"""


@query(S.cte(S.LINES) + QUALITY)
def page_quality(spark, sf):
    rows = V.lines(spark, sf)
    words = staged(reconcile.page_words(rows))
    frequencies = words.groupBy("token").agg((F.log(F.count("*")) / F.log(F.lit(10.0))).alias("zipf"))
    return reconcile.page_quality(rows, frequencies, 0.5, words).select("doc_id", "page_number", F.round("quality", 3).alias("quality"), _listed("reasons").alias("reasons"))


COVERAGE = """, t AS (SELECT DISTINCT line_id FROM lines WHERE seq % 40 BETWEEN 12 AND 17 AND doc_id % 3 = 0),
o AS (SELECT l.line_id, e.type, greatest(0, least(l.y2, e.e2) - greatest(l.y1, e.e1)) / (l.y2 - l.y1) AS share FROM lines l JOIN elements e USING (doc_id, page_number)),
d AS (SELECT l.doc_id, l.line_id, l.page_number, CASE WHEN l.line_id IN (SELECT line_id FROM t) THEN 'table_cell' WHEN l.line_id IN (SELECT line_id FROM o WHERE type = 'figure' AND share >= 0.70) THEN 'figure_label' WHEN l.line_id IN (SELECT line_id FROM o WHERE type = 'formula' AND share >= 0.55) THEN 'verified_duplicate' WHEN trim(l.text) <> '' THEN 'prose' ELSE 'unresolved' END AS disposition FROM lines l)
"""


def _dispositions(spark, sf):
    rows = V.lines(spark, sf)
    in_table = rows.filter((F.col("seq") % 40).between(12, 17) & (F.col("doc_id") % 3 == 0)).select("doc_id", "line_id")
    return reconcile.dispositions(rows, V.elements(spark, sf), in_table)


@query(S.cte(S.LINES, S.ELEMENTS) + COVERAGE + """SELECT doc_id, count(*) AS raw_line_count, count(*) FILTER (disposition = 'prose') AS n_prose, count(*) FILTER (disposition = 'table_cell') AS n_table_cell, count(*) FILTER (disposition = 'figure_label') AS n_figure_label, count(*) FILTER (disposition = 'verified_duplicate') AS n_verified_duplicate,
count(*) FILTER (disposition = 'unresolved') AS n_unresolved, CASE WHEN count(*) FILTER (disposition = 'unresolved') = 0 THEN 'passed' ELSE 'failed' END AS status FROM d GROUP BY doc_id""")
def content_coverage(spark, sf):
    return reconcile.content_coverage(_dispositions(spark, sf)).drop("n_user_removed", "coverage_percent")


@query(S.cte(S.LINES, S.ELEMENTS) + COVERAGE + ", u AS (SELECT doc_id, count(*) AS n FROM d WHERE disposition = 'unresolved' GROUP BY doc_id), x AS (SELECT l.doc_id, count(*) FILTER (confidence < 0.90) AS low_confidence_count, coalesce(any_value(u.n), 0) AS unaccounted_line_count FROM lines l LEFT JOIN u ON u.doc_id = l.doc_id GROUP BY l.doc_id) SELECT *, CASE WHEN low_confidence_count + unaccounted_line_count > 0 THEN 'needs_review' ELSE 'good' END AS status FROM x")
def document_quality(spark, sf):
    none = V.evidence(spark, sf).filter("false")
    tables, reviews = none.select("doc_id", F.lit("").alias("status")), none.select("doc_id", F.lit("").alias("kind"))
    return reconcile.document_quality(V.lines(spark, sf), tables, reconcile.content_coverage(_dispositions(spark, sf)), reviews).select("doc_id", "low_confidence_count", "unaccounted_line_count", "status")


@query(S.cte(S.LINES, S.ELEMENTS) + COVERAGE + """, u AS (SELECT doc_id, count(*) AS n FROM d WHERE disposition = 'unresolved' GROUP BY doc_id), x AS (SELECT doc_id, count(*) FILTER (confidence < 0.90) AS low_confidence_count, count(DISTINCT page_number) FILTER (doc_id % 4 IN (0, 3) OR doc_id % 9 = 0) AS unverified_table_count, count(*) FILTER (seq % 50 = 7 AND contains(text, 'e')) AS improbable_token_count, count(*) FILTER (seq % 50 = 7) AS review_count FROM lines GROUP BY doc_id)
SELECT x.*, coalesce(u.n, 0) AS unaccounted_line_count, CASE WHEN low_confidence_count + unverified_table_count + coalesce(u.n, 0) + review_count > 0 THEN 'needs_review' ELSE 'good' END AS status FROM x LEFT JOIN u USING (doc_id)""")
def document_quality_whole(spark, sf):
    """With the tables' states (a page's table is unverified in every fourth document, or where its geometry is weak) and reviews of lines."""
    cells = V.cells(spark, sf)
    scored = reconcile.table_geometry(cells).select("doc_id", "table_index", "geometry_score")
    tables = scored.select("doc_id", F.when((F.col("doc_id") % 4 == 0) | (F.col("geometry_score") < 0.6), "review").otherwise("accepted").alias("status"))
    kind = F.when(F.contains("text", F.lit("e")), F.when(F.col("seq") % 100 == 7, "spelling").otherwise("word_boundary")).otherwise("punctuation")
    reviews = V.lines(spark, sf).filter("seq % 50 = 7").select("doc_id", kind.alias("kind"))
    return reconcile.document_quality(V.lines(spark, sf), tables, reconcile.content_coverage(_dispositions(spark, sf)), reviews)


CELLS = """, cells AS (SELECT doc_id, page_number, c AS cell_index, ([0.1, 0.35, 0.65, 0.9]::DOUBLE[])[c % 3 + 1] AS cx1, ([0.1, 0.35, 0.65, 0.9]::DOUBLE[])[c % 3 + 2] AS cx2, ([0.3, 0.375, 0.45]::DOUBLE[])[c // 3 + 1] AS cy1, ([0.3, 0.375, 0.45]::DOUBLE[])[c // 3 + 2] AS cy2 FROM (SELECT DISTINCT doc_id, page_number FROM lines), (SELECT unnest(range(6)) AS c))
"""


ASSIGNED = CELLS + """, m AS (SELECT l.doc_id, l.page_number, l.line_id, c.cell_index, (greatest(0, least(0.9, cx2) - greatest(0.1, cx1)) * greatest(0, least(y2, cy2) - greatest(y1, cy1))) / ((0.9 - 0.1) * (y2 - y1)) AS overlap, 0.5 BETWEEN cx1 AND cx2 AND (y1 + y2) / 2 BETWEEN cy1 AND cy2 AS centred,
(y1 + y2) / 2 BETWEEN cy1 AND cy1 + 0.35 * (cy2 - cy1) AS aligned, abs(0.5 - (cx1 + cx2) / 2) / (cx2 - cx1) + abs((y1 + y2) / 2 - (cy1 + cy2) / 2) / (cy2 - cy1) AS far FROM lines l JOIN cells c USING (doc_id, page_number)),
s AS (SELECT *, overlap + CASE WHEN centred THEN 0.25 ELSE 0 END + CASE WHEN aligned THEN 0.08 ELSE 0 END - 0.05 * far AS score FROM m WHERE overlap >= 0.20 OR centred),
assigned AS (SELECT doc_id, page_number, line_id, page_number AS table_index, cell_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, line_id ORDER BY score DESC, cell_index DESC) AS rn FROM s) WHERE rn = 1)"""


@query(S.cte(S.LINES) + ASSIGNED + " SELECT * FROM assigned")
def assign_lines_to_cells(spark, sf):
    return reconcile.assign_lines_to_cells(V.lines(spark, sf), V.cells(spark, sf)).drop("score")


@query(S.cte(S.LINES) + """, g AS (SELECT DISTINCT doc_id, page_number AS table_index FROM lines), b AS (SELECT *, (SELECT count(*) FROM range(6) r(c) WHERE (doc_id + c) % 4 = 0) / 6.0::DOUBLE AS blank FROM g)
SELECT doc_id, table_index, round(greatest(0, least(1, 0.65 + 0.25 + CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0 END - 0.5 * blank - CASE WHEN doc_id % 2 = 1 AND doc_id % 9 <> 0 THEN 0.2 ELSE 0 END - CASE WHEN doc_id % 9 = 0 THEN 0.35 ELSE 0 END)), 3) AS geometry_score FROM b""")
def table_quality(spark, sf):
    return reconcile.table_geometry(V.cells(spark, sf)).withColumn("geometry_score", F.round("geometry_score", 3))


def _verified(spark, sf):
    tables = V.cells(spark, sf).select("doc_id", "table_index", "geometry_normalized").distinct().withColumn("bbox_identity_score", F.lit(0.9))
    return reconcile.verify_tables(tables, V.cells(spark, sf), V.lines(spark, sf))


@query()
def verify_tables(spark, sf):
    return _verified(spark, sf)


TABLE_TOKENS = r"unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{N}]+')) AS w"


@query(S.cte(S.LINES) + ASSIGNED + rf""", at_ AS (SELECT l.*, a.table_index, a.cell_index FROM assigned a JOIN lines l USING (doc_id, line_id)),
src AS (SELECT doc_id, table_index, cell_index, string_agg(text, ' ' ORDER BY seq) AS st, avg(confidence) AS sc FROM at_ GROUP BY ALL),
own AS (SELECT doc_id, page_number AS table_index, cell_index, CASE WHEN (doc_id + cell_index) % 4 = 0 THEN '' ELSE 'cell ' || cell_index END AS own FROM cells),
met AS (SELECT doc_id, table_index, cell_index, CASE WHEN coalesce(st, '') <> '' AND sc >= CASE WHEN own <> '' THEN 0.90 ELSE 0.85 END THEN st ELSE own END AS text FROM own LEFT JOIN src USING (doc_id, table_index, cell_index)),
cw AS (SELECT doc_id, table_index, string_agg(text, ' ' ORDER BY cell_index) AS text FROM met GROUP BY ALL), lw AS (SELECT doc_id, table_index, string_agg(text, ' ' ORDER BY seq) AS text FROM at_ GROUP BY ALL),
cn AS (SELECT doc_id, table_index, w, count(*) AS n FROM (SELECT doc_id, table_index, {TABLE_TOKENS} FROM cw) GROUP BY ALL), ln AS (SELECT doc_id, table_index, w, count(*) AS n FROM (SELECT doc_id, table_index, {TABLE_TOKENS} FROM lw) GROUP BY ALL),
sc AS (SELECT doc_id, table_index, sum(least(ln.n, coalesce(cn.n, 0))) / sum(ln.n) AS v FROM ln LEFT JOIN cn USING (doc_id, table_index, w) GROUP BY ALL), tc AS (SELECT doc_id, table_index, sum(least(cn.n, coalesce(ln.n, 0))) / sum(cn.n) AS v FROM cn LEFT JOIN ln USING (doc_id, table_index, w) GROUP BY ALL),
pl AS (SELECT doc_id, table_index, regexp_extract_all(text, '[^ \t\n\f\r\v]+') AS ws FROM cw)
SELECT pl.doc_id, CAST(pl.table_index AS INTEGER) AS table_index, round(round(coalesce(sc.v, 1)::DOUBLE, 4), 3) AS source_coverage, round(round(coalesce(tc.v, 1)::DOUBLE, 4), 3) AS table_token_coverage, CASE WHEN pl.doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS orientation,
CASE WHEN lw.doc_id IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS bbox_identity, round(round((CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda x: regexp_matches(x, '[\p{{L}}\p{{M}}\p{{N}}_]'))) / len(ws) END)::DOUBLE, 4), 3) AS plausibility
FROM pl LEFT JOIN lw USING (doc_id, table_index) LEFT JOIN sc USING (doc_id, table_index) LEFT JOIN tc USING (doc_id, table_index)""")
def table_components(spark, sf):
    """What tables are verified by, but for the geometry (``table_quality``) and the ratio of texts."""
    return _verified(spark, sf).select("doc_id", "table_index", "orientation", "bbox_identity", *[F.round(c, 3).alias(c) for c in ("source_coverage", "table_token_coverage", "plausibility")])


@query(S.cte(S.LINES) + """, f AS (SELECT *, regexp_matches(trim(text), '^(?:\\d{1,3}\\s*[.)]|\\(?[a-z]\\)|\\([ivxlcdm]+\\))\\s*', 'i') AS starts FROM lines), k AS (SELECT *, coalesce(min(CASE WHEN starts THEN y1 END) OVER (PARTITION BY doc_id, page_number), 0.28) AS first_y FROM f),
t AS (SELECT *, CASE WHEN starts THEN 'question' WHEN y1 < least(0.25, first_y) AND length(trim(text)) <= 100 THEN 'heading' ELSE 'text' END AS type FROM k),
p AS (SELECT *, lag(type) OVER w AS pt, y1 - lag(y2) OVER w AS gap, greatest(0.001, lag(y2) OVER w - lag(y1) OVER w) AS h FROM t WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY seq)),
j AS (SELECT *, coalesce(type = 'text' AND pt IN ('text', 'question') AND trim(text) <> '' AND NOT starts AND gap BETWEEN -h AND 1.8 * h, false) AS joins FROM p),
n AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number ORDER BY seq ROWS UNBOUNDED PRECEDING) AS paragraph FROM j)
SELECT doc_id, page_number, CAST(paragraph AS BIGINT) AS paragraph, sha256(string_agg(text, ' ' ORDER BY seq)) AS content_hash, arg_min(type, seq) AS type, string_agg(line_id, ',' ORDER BY seq) AS line_ids, min(confidence) AS confidence FROM n GROUP BY ALL""".replace("\\\\", "\\"))
def paragraphs(spark, sf):
    p = segment.join_paragraph_lines(segment.classify_exam_lines(V.lines(spark, sf)))
    return p.select("doc_id", "page_number", "paragraph", F.sha2("content", 256).alias("content_hash"), "type", _listed("line_ids").alias("line_ids"), "confidence")


@query(S.cte(S.LINES) + "SELECT doc_id, line_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y1, seq) AS INTEGER) AS place FROM lines")
def reading_order(spark, sf):
    return segment.reading_order(V.lines(spark, sf)).select("doc_id", "line_id", "place")


@query(S.cte(S.LINES) + ", p AS (SELECT doc_id, page_number, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY seq)) AS text_hash FROM lines GROUP BY ALL) SELECT doc_id, page_number, n_lines, text_hash, CAST(sum(n_lines) OVER (PARTITION BY doc_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_end FROM p")
def combine_pages(spark, sf):
    return segment.combine_pages(V.lines(spark, sf))[1].select("doc_id", "page_number", "n_lines", F.sha2("full_text", 256).alias("text_hash"), "line_end")


@query(S.cte(S.LINES) + """, m AS (SELECT doc_id, page_number, line_id, seq, (y1 + y2) / 2 + 0.02 AS my FROM lines WHERE seq % 13 = 5), c AS (SELECT m.doc_id, m.page_number, 'm' || m.seq AS mark_line_id, l.line_id, row_number() OVER (PARTITION BY m.line_id ORDER BY round(abs((l.y1 + l.y2) / 2 - m.my), 9), l.seq) AS rn FROM m JOIN lines l ON l.doc_id = m.doc_id AND l.page_number = m.page_number AND abs((l.y1 + l.y2) / 2 - m.my) <= 0.025)
SELECT doc_id, page_number, mark_line_id, line_id, '07' AS mark FROM c WHERE rn = 1""")
def margin_marks(spark, sf):
    rows = V.lines(spark, sf).filter(~F.trim("text").rlike(r"^\d{1,2}$")).select("doc_id", "page_number", "line_id", "seq", "text", "normalized_bbox")
    all_rows = V.lines(spark, sf)
    box = F.col("normalized_bbox")
    marks = all_rows.filter("seq % 13 = 5").select("doc_id", "page_number", F.concat(F.lit("m"), "seq").alias("line_id"), "seq", F.lit("7").alias("text"), F.array(F.lit(0.85), F.get(box, F.lit(1)) + 0.02, F.lit(0.9), F.get(box, F.lit(3)) + 0.02).alias("normalized_bbox"))
    return reconcile.attach_margin_marks(rows.union(marks.filter(F.get(box, F.lit(3)) <= 0.95)))


del ORACLES["margin_marks"]  # whether a mark lies in the margin depends on the last bits of its box


@query(S.cte(S.LINES, S.ELEMENTS) + "SELECT e.doc_id, element_id, sha256(arg_max(substr(text, 1, 180), seq)) AS caption_hash FROM elements e JOIN lines l ON l.doc_id = e.doc_id AND l.page_number = e.page_number AND (l.y1 + l.y2) / 2 < (e.e1 + e.e2) / 2 WHERE e.type = 'figure' GROUP BY ALL")
def captions(spark, sf):
    return reconcile.caption_context(V.elements(spark, sf).filter("type = 'figure'"), V.lines(spark, sf)).select("doc_id", "element_id", F.sha2("caption", 256).alias("caption_hash"))


@query(S.cte(S.LINES, S.ELEMENTS) + """, b AS (SELECT doc_id, page_number, seq, line_id, (y1 + y2) / 2 AS y FROM lines), a AS (SELECT doc_id, page_number, element_id, (e1 + e2) / 2 AS ay FROM elements),
f AS (SELECT a.doc_id, a.page_number, element_id, ay, min(seq) FILTER (y > ay) AS before FROM a LEFT JOIN b ON b.doc_id = a.doc_id AND b.page_number = a.page_number GROUP BY ALL),
o AS (SELECT doc_id, page_number, coalesce(before - 0.5, 1e18) AS spot, 0 AS kind, element_id, NULL AS line_id, ay FROM f UNION ALL SELECT doc_id, page_number, seq, 1, NULL, line_id, y FROM b)
SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY spot, kind, ay, element_id) AS INTEGER) AS place, element_id, line_id FROM o""")
def merge_anchors(spark, sf):
    return reconcile.merge_anchors(V.lines(spark, sf), V.elements(spark, sf))


@query()
def header_consensus(spark, sf):
    return similarity.header_consensus(V.lines(spark, sf))


CER = "SELECT item_id, text AS e, CASE WHEN item_id % 2 = 0 THEN replace(text, 'e', 'c') ELSE text END AS a FROM benchmark"


@query(f"SELECT item_id, round(levenshtein(e, a) / length(e), 6) AS character_error_rate FROM ({CER})")
def cer(spark, sf):
    return _spoiled(spark, sf).select("item_id", X.character_error_rate("e", "a").alias("character_error_rate"))


def _spoiled(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "benchmark").select("item_id", t.alias("e"), F.when(F.col("item_id") % 2 == 0, F.replace(t, F.lit("e"), F.lit("c"))).otherwise(t).alias("a"))


@query(f"WITH c AS ({CER}), w AS (SELECT item_id, string_split(trim(regexp_replace(e, '\\s+', ' ', 'g')), ' ') AS e, string_split(trim(regexp_replace(a, '\\s+', ' ', 'g')), ' ') AS a FROM c) SELECT item_id, round(len(list_filter(list_zip(e, a), lambda p: p[1] <> p[2])) / len(e), 6) AS word_error_rate FROM w")
def wer(spark, sf):
    return _spoiled(spark, sf).select("item_id", X.word_error_rate("e", "a").alias("word_error_rate"))


@query(r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS e FROM benchmark), a AS (SELECT item_id, e, flatten(list_transform(e, lambda x, i: CASE WHEN (i + item_id) % 5 = 0 THEN [] WHEN (i + item_id) % 7 = 0 THEN [x, x] WHEN (i + item_id) % 11 = 0 THEN [x || '_'] ELSE [x] END)) AS a FROM w),
k AS (SELECT item_id, e, a, list_distinct(list_concat(e, a)) AS known FROM a), c AS (SELECT item_id, len(e) AS n, len(known) AS kinds, array_to_string(list_transform(e, lambda x: chr(CAST(32 + list_position(known, x) AS INTEGER))), '') AS e, array_to_string(list_transform(a, lambda x: chr(CAST(32 + list_position(known, x) AS INTEGER))), '') AS a FROM k)
SELECT item_id, CASE WHEN kinds > 94 THEN error('too many kinds of words for one sign each') ELSE round(levenshtein(e, a) / n, 6) END AS word_error_rate FROM c""")
def wer_edits(spark, sf):
    """Words left out, doubled and changed; the SQL gives each kind of word of a pair one ASCII sign."""
    items = V.table(spark, sf, "benchmark").withColumn("w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    key = lambda i: i + 1 + F.col("item_id")
    spoiled = F.transform("w", lambda x, i: F.when(key(i) % 5 == 0, F.array().cast("array<string>")).when(key(i) % 7 == 0, F.array(x, x)).when(key(i) % 11 == 0, F.array(F.concat(x, F.lit("_")))).otherwise(F.array(x)))
    return items.select("item_id", X.word_error_rate("text", F.array_join(F.flatten(spoiled), " ")).alias("word_error_rate"))


@query(f"SELECT count(*) AS case_count, round(avg(round(levenshtein(e, a) / length(e), 6)), 6) AS character_error_rate FROM ({CER})")
def score_report(spark, sf):
    return reports.benchmark_report(cer(spark, sf), ["character_error_rate"])


@query("""WITH b AS (SELECT item_id AS k, text FROM benchmark), d AS (SELECT doc_id AS k, text FROM documents), x AS (SELECT k, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\pL\\pN_]+')) AS w FROM b), y AS (SELECT k, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\pL\\pN_]+')) AS w FROM d),
xc AS (SELECT k, w, count(*) AS n FROM x GROUP BY ALL), yc AS (SELECT k, w, count(*) AS n FROM y GROUP BY ALL) SELECT k, round(sum(least(xc.n, coalesce(yc.n, 0))) / sum(xc.n), 6) AS coverage FROM xc LEFT JOIN yc USING (k, w) GROUP BY k""")
def multiset_coverage(spark, sf):
    b = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("k"), "text")
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("k"), "text")
    return similarity.multiset_coverage(b, d, ["k"]).withColumn("coverage", F.round("coverage", 6))


@query("SELECT doc_id, CAST(len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^\\pL\\pN_]+', '  ', 'g') || ' ', ' (?:license|the) ')) AS INTEGER) AS n_terms FROM documents")
def remove_terms(spark, sf):
    docs = V.table(spark, sf, "documents")
    found = docs.select("doc_id", X.count_terms("text", ["License", "the"]).alias("n_terms"), X.count_terms(X.remove_terms("text", ["License", "the"]), ["License", "the"]).alias("left"))
    return found.select("doc_id", F.when(F.col("left") == 0, F.col("n_terms")).alias("n_terms"))


@query(r"""WITH q AS (SELECT conv_id AS s, 'q-' || turn AS question_id, CAST(turn + 1 AS VARCHAR) AS number FROM conversations WHERE role = 'user'),
k AS (SELECT s, number, max(question_id) AS named FROM q GROUP BY ALL), one AS (SELECT s, min(question_id) AS only_one FROM q GROUP BY s HAVING count(*) = 1),
r AS (SELECT conv_id AS s, turn AS seq, conv_id || ':' || turn AS line_id, CASE WHEN turn % 3 <> 2 THEN turn || '. ' || text ELSE text END AS text FROM conversations WHERE role <> 'user'),
m AS (SELECT *, nullif(regexp_replace(regexp_replace(lower(regexp_extract(text, '^\s*(?:question\s+)?(\d+(?:\s*\([a-z0-9ivx]+\))?|[a-z])\s*[.):\-]', 1, 'i')), '\s+', '', 'g'), '[.)]+$', ''), '') AS number FROM r),
p AS (SELECT m.*, named, coalesce(last_value(named IGNORE NULLS) OVER (PARTITION BY m.s ORDER BY seq ROWS UNBOUNDED PRECEDING), only_one) AS question_id FROM m LEFT JOIN k ON k.s = m.s AND k.number = m.number LEFT JOIN one ON one.s = m.s),
a AS (SELECT s, question_id, string_agg(text, chr(10) ORDER BY seq) AS text, string_agg(line_id, ',' ORDER BY seq) AS line_ids, bool_or(coalesce(named = question_id, false)) AS explicit FROM p WHERE question_id IS NOT NULL GROUP BY ALL)
SELECT q.s AS script_id, q.question_id, sha256(coalesce(text, '')) AS text_hash, line_ids, CASE WHEN text IS NOT NULL THEN 0.9 END::DOUBLE AS ocr_confidence, CASE WHEN explicit THEN 0.95 WHEN text IS NOT NULL THEN 0.75 ELSE 0.0 END::DOUBLE AS alignment_confidence FROM q LEFT JOIN a ON a.s = q.s AND a.question_id = q.question_id""")
def answer_alignment(spark, sf):
    c = V.table(spark, sf, "conversations")
    q = c.filter("role = 'user'").select(F.col("conv_id").alias("script_id"), F.concat(F.lit("q-"), "turn").alias("question_id"), (F.col("turn") + 1).cast("string").alias("display_number"))
    marked = F.when(F.col("turn") % 3 != 2, F.concat((F.col("turn")).cast("string"), F.lit(". "), "text")).otherwise(F.col("text"))
    r = c.filter("role <> 'user'").select(F.col("conv_id").alias("script_id"), F.col("turn").alias("seq"), F.concat_ws(":", "conv_id", "turn").alias("line_id"), F.lit(1).alias("page"), marked.alias("text"), F.lit(0.9).alias("ocr_confidence"))
    a = segment.align_answers(q, r)
    return a.select("script_id", "question_id", F.sha2("response_text", 256).alias("text_hash"), _listed("response_line_ids").alias("line_ids"), "ocr_confidence", "alignment_confidence")


@query(S.cte(S.REQUESTS) + "SELECT event_id, key, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN request_hash = first_value(request_hash) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM requests WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)")
def idempotent_replay(spark, sf):
    return jobs.idempotent(V.requests(spark, sf)).select("event_id", "key", "outcome")


@query("""WITH d AS (SELECT event_id AS delivery_id, event_id % 40 AS subscription_id, event_id % 20000 AS e, CAST(event_id % 12 AS INTEGER) AS attempt, ts FROM events WHERE event_type IN ('error', 'view') AND ts <= TIMESTAMP '2024-01-15')
SELECT delivery_id, attempt, CASE WHEN subscription_id >= 35 THEN 'fail_missing_parent' WHEN attempt + 1 > 10 THEN 'fail_exhausted' ELSE 'post' END AS action,
CASE WHEN subscription_id < 35 AND attempt + 1 < 10 THEN TIMESTAMP '2024-01-15' + to_seconds(CAST(least(3600, 15 * pow(2, least(attempt + 1, 8))) AS INTEGER)) END AS retry_at FROM d""")
def delivery_plan(spark, sf):
    e = V.table(spark, sf, "events")
    d = e.filter("event_type in ('error', 'view')").select(F.col("event_id").alias("delivery_id"), "event_id", (F.col("event_id") % 40).alias("subscription_id"), (F.col("event_id") % 12).cast("int").alias("attempt"), F.lit("pending").alias("status"), F.col("ts").alias("next_attempt_at"))
    subscriptions = e.select((F.col("event_id") % 40).alias("subscription_id")).distinct().filter("subscription_id < 35")
    return jobs.dispatch_plan(d, subscriptions, e.select("event_id"), datetime(2024, 1, 15)).select("delivery_id", "attempt", "action", "retry_at")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id AS job_id, event_id, 'queued' AS status FROM l WHERE rn = 1 AND event_type IN ('view', 'click') AND (event_type = 'click' OR ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-31')""")
def expired_leases(spark, sf):
    e = V.table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("job_id"), "event_id", "ts", F.when(F.col("event_type").isin("view", "click"), "claimed").otherwise("done").alias("status"), F.when(F.col("event_type") == "view", jobs.seconds_later("ts", F.lit(3600))).alias("lease_expires_at"))
    return jobs.expired_leases(jobs.latest_state(rows, "job_id", "ts", "event_id"), datetime(2024, 1, 31)).select("job_id", "event_id", "status")


@query("""WITH l AS (SELECT user_id AS key, count(*) OVER (PARTITION BY user_id) AS attempts, event_type = 'purchase' AS ok, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT key, attempts, CASE WHEN ok THEN 'delivered' ELSE 'pending' END AS state, CASE WHEN NOT ok THEN ts + to_seconds(CAST(least(3600, 30 * pow(2, least(attempts, 7))) AS INTEGER)) END AS next_attempt_at FROM l WHERE rn = 1""")
def outbox_state(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"))
    return jobs.outbox_state(e)


SUBSCRIPTIONS = "(1, ['view']), (2, ['click', 'error']), (3, ['*'])"


@query(f"SELECT DISTINCT e.event_id, s.id AS subscription_id FROM events e JOIN (VALUES {SUBSCRIPTIONS}) s(id, types) ON list_contains(types, e.event_type) OR list_contains(types, '*')")
def fan_out(spark, sf):
    subs = spark.sql("select * from values (1, array('view')), (2, array('click', 'error')), (3, array('*')) as t(subscription_id, event_types)")
    return governance.fan_out(V.table(spark, sf, "events").select("event_id", F.col("event_type").alias("action")), subs)


def _scratch(spark: SparkSession) -> str:
    """A new folder for a stream's table and checkpoint, in the folder that executors share."""
    return new_folder(spark, "stream")


def _event_files(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files: a batch copy in a folder of its own, as a file source reads folders."""
    at = _scratch(spark)
    V.table(spark, sf, "events").write.parquet(at)
    return stream.event_stream(spark, at, spark.read.parquet(at).schema)


@query("SELECT event_id AS sequence, user_id % 10 AS tenant, event_type AS action, ts AS created_at FROM events WHERE event_id > 100")
def audit_tail_stream(spark, sf):
    at = _scratch(spark)
    return stream.run_once(stream.tail_audit(_event_files(spark, sf).withColumn("tenant", F.col("user_id") % 10), 100), f"{at}/out", f"{at}/state")


@query("""WITH e AS (SELECT event_id, user_id AS resource_id, props, CASE WHEN event_type = 'error' THEN 'event_type' WHEN event_id % 9 = 0 THEN 'evidence_hash' WHEN event_id % 10 = 0 THEN 'overlay_hash' ELSE 'ok' END AS verdict FROM events)
SELECT 'evidence' AS kind, CAST(resource_id AS VARCHAR) || ':' || sha256(props) AS id FROM e WHERE verdict = 'ok' GROUP BY ALL UNION ALL SELECT verdict, CAST(event_id AS VARCHAR) FROM e WHERE verdict <> 'ok'""")
def sync_ingest_stream(spark, sf):
    at = _scratch(spark)
    none = F.array().cast("array<struct<media_type:string,size:int,approved:boolean>>")
    own = F.sha2("props", 256)
    e = _event_files(spark, sf).select(
        "event_id", F.when(F.col("event_type") == "error", "other").otherwise("archive.upsert").alias("event_type"), F.col("user_id").alias("resource_id"), F.col("props").alias("evidence"),
        F.when(F.col("event_id") % 9 == 0, F.lit("wrong")).otherwise(own).alias("evidence_hash"), F.when(F.col("event_id") % 10 == 0, F.lit("other")).alias("overlay_hash"), none.alias("previews"), F.col("ts").alias("occurred_at"),
    )
    stream.ingest_sync(e, f"{at}/out", f"{at}/state").awaitTermination()
    good = spark.read.parquet(f"{at}/out/evidence").select(F.lit("evidence").alias("kind"), F.concat_ws(":", F.col("resource_id").cast("string"), "evidence_hash").alias("id"))
    return good.union(spark.read.parquet(f"{at}/out/rejected").select(F.col("verdict").alias("kind"), F.col("event_id").cast("string").alias("id")))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    return stream.event_windows(V.table(spark, sf, "events")).withColumn("total", F.round("total", 2))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY user_id, k""")
def user_sessions(spark, sf):
    return stream.sessions(V.table(spark, sf, "events"))


@query()
def page_cells(spark, sf):
    pages = V.table(spark, sf, "pages")
    grid = F.transform(F.split("url", "/"), lambda p: F.concat(F.lit("<td>"), p, F.lit("</td>")))
    wide = F.when(F.col("page_id") % 3 == 0, F.lit('<tr><td colspan="2">head</td><td rowspan="2">side</td></tr><tr><td>a</td><td>b</td></tr>')).otherwise("")
    with_tables = pages.select("page_id", F.concat("html", F.lit("<table><tr>"), F.array_join(grid, ""), F.lit("</tr>"), wide, F.lit("</table>")).alias("html"))
    return reconcile.extract_cells(with_tables)


@query(S.cte(S.QUESTIONS) + """, i AS (SELECT doc_id, group_no, (doc_id + group_no) % 2 = 0 AS ok, {'question_id': question_id, 'text': text, 'topic': topic, 'difficulty': difficulty, 'language': 'en', 'provenance': 'archive'} AS item FROM questions)
SELECT doc_id, CAST(count(*) FILTER (ok) AS INTEGER) AS n_items, sha256(coalesce(CAST(to_json(list(item ORDER BY group_no) FILTER (ok)) AS VARCHAR), '[]')) AS items_hash FROM i GROUP BY doc_id""")
def student_pack(spark, sf):
    q = V.questions(spark, sf)
    item = F.struct("question_id", "text", "topic", F.lit(None).cast("string").alias("objective"), "difficulty", F.lit("en").alias("language"), F.lit("archive").alias("provenance"), F.lit(None).cast("string").alias("accessibility_description"), ((F.col("doc_id") + F.col("group_no")) % 2 == 0).alias("teacher_approved"))
    packs = q.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_no", item.alias("i")))), lambda s: s["i"]).alias("items"))
    return governance.student_safe(packs).select("doc_id", F.size("items").alias("n_items"), F.sha2(F.to_json("items"), 256).alias("items_hash"))


@query(S.cte(S.QUESTIONS) + "SELECT doc_id || ':' || group_no AS item_id, topic, difficulty FROM questions WHERE (doc_id + group_no) % 4 = 0 AND doc_id % 5 <> 0")
def bank_export(spark, sf):
    from paperloom.sources import sinks

    key = (F.col("doc_id") + F.col("group_no")) % 4
    bank = V.questions(spark, sf).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("group_no").cast("string")).alias("item_id"), "text", "topic", "difficulty", F.when(key == 0, "approved").otherwise("draft").alias("status"), (F.col("doc_id") % 5 == 0).alias("stale"))
    rows = sinks.export_question_bank(bank, "jsonl")
    return rows.select(F.get_json_object("value", "$.item_id").alias("item_id"), F.get_json_object("value", "$.topic").alias("topic"), F.get_json_object("value", "$.difficulty").alias("difficulty"))


@query("SELECT topic AS label, 'legacy-' || substr(sha256(lower(topic)), 1, 16) AS node_id, 'legacy-root' AS parent_id FROM (SELECT DISTINCT trim(source) AS topic FROM documents UNION SELECT DISTINCT trim(p_brand) FROM part UNION SELECT DISTINCT trim(p_type) FROM part)")
def legacy_topics(spark, sf):
    part = V.table(spark, sf, "part")
    return reports.legacy_topics(V.table(spark, sf, "documents").select(F.col("source").alias("topic")), part.select(F.col("p_brand").alias("topic")), part.select(F.col("p_type").alias("topic")))


@query(S.cte(S.QUESTIONS) + ", p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY group_no) AS place FROM questions) SELECT doc_id, CAST(place AS INTEGER) AS place, question_id, sha256('Practise: ' || substr(text, 1, 900)) AS starter_hash FROM p WHERE place <= 20")
def practice_starters(spark, sf):
    return reports.practice_starters(V.questions(spark, sf)).select("doc_id", "place", "question_id", F.sha2("starter", 256).alias("starter_hash"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), t AS (SELECT doc_id, i, regexp_replace(raw, '^[ \\t\\-•]+|[ \\t\\-•]+$', '', 'g') AS t FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM t WHERE length(t) >= 8)
SELECT doc_id, CAST(place AS INTEGER) AS place, substr(t, 1, 256) AS label, true AS inferred, false AS confirmed FROM n WHERE place <= 500""")
def infer_objectives(spark, sf):
    return readers.infer_objectives(V.table(spark, sf, "documents"))


@query("SELECT l_orderkey AS batch_id, CASE WHEN bool_and(l_linestatus = 'F') THEN 'completed' WHEN NOT bool_or(l_linestatus = 'O') THEN 'partial' ELSE 'processing' END AS status, count(*) AS n_items FROM lineitem GROUP BY 1")
def batch_status(spark, sf):
    items = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("queued").alias("status"))
    return jobs.batch_status(items)


@query(S.cte(S.LINES) + "SELECT doc_id, line_id, round(least(y2, 0.5) - greatest(y1, 0.3), 6) AS shared FROM lines WHERE y2 > 0.3 AND y1 < 0.5 AND round(least(y2, 0.5) - greatest(y1, 0.3), 6) > 0")
def overlap_lines(spark, sf):
    band = F.array(F.lit(0.1), F.lit(0.3), F.lit(0.9), F.lit(0.5))
    height = G.shared_area("normalized_bbox", band) / 0.8
    return V.lines(spark, sf).select("doc_id", "line_id", F.round(height, 6).alias("shared")).filter("shared > 0")

"""The views, and what the queries compute, as SQL."""

from __future__ import annotations

#: The question-number and marks patterns in RE2 syntax.
PREFIX = r"^\s*(?:(?:question|q)\s*)?(\d{1,3}(?:\s*[.(]\s*[a-zA-ZivxIVX]{1,6}\s*\))?|\d{1,3}(?:\s*[.(]\s*\d{1,3}\s*\))?|[a-zA-Z]\s*\))\s*(?:[.:)\-–—]\s*)?"
MARKS = r"(?:\(\s*(\d{1,3})\s*(?:marks?|m)\s*\)|\[\s*(\d{1,3})\s*\]|(\d{1,3})\s*(?:marks?|m)\b)"

LINES = """
parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents),
lines AS (SELECT doc_id, source, seq, seq // 40 + 1 AS page_number, doc_id || ':' || seq AS line_id,
  CASE WHEN seq % 3 = 0 THEN (seq // 3 + 1) || '. ' || part || ' (' || ((doc_id + seq) % 10 + 1) || ' marks)' ELSE part END AS text,
  CAST((doc_id * 31 + seq * 17) % 41 + 60 AS DOUBLE) / 100 AS confidence, CAST(seq % 40 AS DOUBLE) / 40 AS y1, CAST(seq % 40 AS DOUBLE) / 40 + 0.02 AS y2 FROM parts)"""

QUESTIONS = (
    LINES
    + f""",
q0 AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM lines),
q1 AS (SELECT *, nullif(trim(regexp_replace(regexp_extract(t, '{PREFIX}', 1, 'i'), '\\s+', ' ', 'g')), '') AS num, regexp_extract(t, '{PREFIX}', 0, 'i') AS whole FROM q0 WHERE t <> ''),
q2 AS (SELECT *, CASE WHEN length(num) <= 20 THEN num END AS number FROM q1),
q3 AS (SELECT *, sum(CASE WHEN number IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS group_no FROM q2),
q4 AS (SELECT *, CASE WHEN number IS NOT NULL THEN coalesce(nullif(trim(substr(t, length(whole) + 1)), ''), t) ELSE t END AS piece FROM q3 WHERE group_no > 0),
q5 AS (SELECT doc_id, CAST(group_no AS BIGINT) AS group_no, max(number) AS display_number, any_value(source) AS source, trim(regexp_replace(string_agg(piece, ' ' ORDER BY seq), '\\s+', ' ', 'g')) AS text,
  arg_min(page_number, seq) AS source_page, string_agg(line_id, ',' ORDER BY seq) AS line_ids, round(min(y1), 5) AS top, round(max(y2), 5) AS bottom, round(avg(confidence), 4) AS ocr_confidence FROM q4 GROUP BY doc_id, group_no),
q6 AS (SELECT *, 'q-' || regexp_replace(regexp_replace(lower(display_number), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base,
  try_cast(coalesce(nullif(regexp_extract(text, '{MARKS}', 1, 'i'), ''), nullif(regexp_extract(text, '{MARKS}', 2, 'i'), ''), nullif(regexp_extract(text, '{MARKS}', 3, 'i'), '')) AS INTEGER) AS m FROM q5),
q7 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY group_no) AS again, CASE WHEN m BETWEEN 1 AND 100 THEN m END AS marks FROM q6),
questions AS (SELECT doc_id, group_no, source, CASE WHEN again = 1 THEN base ELSE base || '-' || again END AS question_id, display_number, text, source_page, line_ids, top, bottom, ocr_confidence, marks,
  CASE WHEN marks IS NULL THEN 'not_detected' ELSE 'explicit' END AS marks_status, CASE WHEN (doc_id + group_no) % 7 = 0 THEN 'teacher-' || source ELSE source END AS topic,
  ['low', 'medium', 'high'][group_no % 3 + 1] AS difficulty FROM q7)"""
)

CORRECTIONS = """
corrections AS (SELECT l.doc_id, 'c-' || line_id AS correction_id, line_id AS target_id, 'corrected: ' || l.text AS replacement, ['draft', 'reviewed', 'approved', 'rejected', 'reverted'][(l.doc_id * 7 + seq) % 5 + 1] AS status,
  l.doc_id % 4 = 0 AS stale FROM lines l WHERE (l.doc_id + seq) % 11 = 0)"""

MAPPINGS = """
mappings AS (SELECT doc_id, question_id, CASE WHEN (doc_id + group_no) % 2 = 0 THEN 'approved' ELSE 'draft' END AS status FROM questions)"""

JOBS = """
jobs AS (SELECT o_orderkey AS job_id, 'Paper_' || o_orderkey || '.pdf' AS input_name, ['text_recognition', 'document_parsing', 'table_recognition', 'formula_recognition'][o_orderkey % 4 + 1] AS workflow,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS created_at, o_orderdate AS updated_at, o_totalprice / 500000 AS quality_score,
  o_orderkey % 5 AS warning_count, o_orderkey % 17 = 0 AS pinned FROM orders)"""

RESOURCES = """
resources AS (SELECT o_orderkey AS resource_id, ['worker_job', 'answer_script', 'dataset_item', 'student_progress'][o_orderkey % 4 + 1] AS resource_type,
  CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'completed' ELSE 'archived' END AS status, n_name AS tenant_id, c_mktsegment AS course_id, c_name AS created_by,
  CASE WHEN o_orderkey % 5 = 0 THEN 'private' ELSE 'tenant' END AS visibility, o_orderdate AS updated_at, o_orderkey % 6 = 0 AS held
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

AUDIT = """
audit0 AS (SELECT user_id % 10 AS tenant, event_id AS sequence, event_type AS action, ts AS created_at, sha256(event_id || '|' || event_type || '|' || epoch_us(ts)) AS event_hash FROM events),
audit AS (SELECT *, CASE WHEN sequence % 501 = 500 THEN 'broken' ELSE lag(event_hash) OVER (PARTITION BY tenant ORDER BY sequence) END AS previous_hash FROM audit0)"""

REQUESTS = """
requests AS (SELECT user_id || '|' || event_type || '|' || json_extract_string(props, '$.k') AS key, sha256(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS request_hash, ts, event_id FROM events)"""

ELEMENTS = """
pages_ AS (SELECT DISTINCT doc_id, page_number FROM lines),
elements AS (SELECT doc_id, page_number, doc_id || '-' || page_number || '-' || k.type AS element_id, k.type, k.y1 AS e1, k.y2 AS e2 FROM pages_, (VALUES ('figure', 0.15::DOUBLE, 0.22::DOUBLE), ('formula', 0.25::DOUBLE, 0.27::DOUBLE)) AS k(type, y1, y2))"""


def cte(*views: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views) + "\n"


def pseudonyms(key: bytes) -> str:
    """Keyed hashes of a tenant and a name, and the 20 letters of their first 100 bits (the last four are zero)."""
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    five = "CAST('0x' || substr(d, {at}, 5) AS BIGINT)"
    letters = " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', CAST(({five.format(at=5 * i + 1)} >> {s}) % 32 + 1 AS BIGINT), 1)" for i in range(5) for s in (15, 10, 5, 0))
    return f"""WITH m AS (SELECT c_custkey, sha256(from_hex('{inner}') || encode(c_nationkey || chr(0) || c_name)) AS h FROM customer), o AS (SELECT c_custkey, substr(sha256(from_hex('{outer}') || from_hex(h)), 1, 24) || '0' AS d FROM m)
SELECT c_custkey, 'learner-' || {letters} AS pseudonym FROM o"""

"""Queries of second readings: lines and pages of documents read twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import readings
from paperloom.plans import sql as S
from paperloom.plans import views as V
from paperloom.plans.catalogue import query
from paperloom.sources.staging import staged

#: Both readings as SQL: every fourth line of the first has its words joined; on two pages of three the second has a sign more, or other signs, on every fourth.
READINGS = """,
one AS (SELECT *, (doc_id + page_number) % 3 = 0 AS whole, (doc_id + seq) % 4 AS kind FROM lines),
first_ AS (SELECT doc_id, page_number, seq, line_id, CASE WHEN kind = 3 THEN replace(text, ' ', '') ELSE text END AS text, confidence FROM one),
two AS (SELECT doc_id, page_number, seq, line_id, whole, kind, CASE WHEN whole OR kind IN (0, 3) THEN text WHEN kind = 1 THEN text || 'ø' ELSE 'ΩΩΩΩΩ' END AS text,
  CASE WHEN whole OR kind IN (0, 1) THEN least(1.0::DOUBLE, confidence + 0.1::DOUBLE) WHEN kind = 2 THEN 0.0::DOUBLE ELSE confidence END AS confidence FROM one),
cut AS (SELECT *, CASE WHEN seq % 5 = 0 THEN strpos(text, ' ') ELSE 0 END AS gap FROM two),
second_ AS (SELECT doc_id, page_number, line_id, whole, kind, seq * 2 AS seq, CASE WHEN gap > 0 THEN substr(text, 1, gap - 1) ELSE text END AS text, confidence FROM cut UNION ALL SELECT doc_id, page_number, line_id, whole, kind, seq * 2 + 1, substr(text, gap + 1), confidence FROM cut WHERE gap > 0)"""

#: What is kept of them. Of two texts one of which has a sign more, or of equal ones, the ratio is known; a page with other signs for a long line is too short.
KEPT = READINGS + r""",
q1 AS (SELECT doc_id, page_number, round(0.58 * avg(confidence) + 0.17 * (1 - avg(CASE WHEN confidence < 0.90 THEN 1.0 ELSE 0.0 END)) + 0.15 + 0.10 * (1 - avg(CASE WHEN regexp_matches(text, '[A-Za-z]{12,}') THEN 1.0 ELSE 0.0 END)), 4) AS score,
  avg(CASE WHEN confidence < 0.90 THEN 1.0 ELSE 0.0 END) >= 0.12 OR avg(CASE WHEN regexp_matches(text, '[A-Za-z]{12,}') THEN 1.0 ELSE 0.0 END) >= 0.04 AS poor, sum(length(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]+', '', 'g'))) AS n FROM first_ GROUP BY ALL),
q2 AS (SELECT doc_id, page_number, round(0.58 * avg(confidence) + 0.17 * (1 - avg(CASE WHEN confidence < 0.90 THEN 1.0 ELSE 0.0 END)) + 0.15 + 0.10 * (1 - avg(CASE WHEN regexp_matches(text, '[A-Za-z]{12,}') THEN 1.0 ELSE 0.0 END)), 4) AS score,
  sum(length(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]+', '', 'g'))) AS n FROM second_ GROUP BY ALL),
page AS (SELECT doc_id, page_number, poor, poor AND q2.score - q1.score >= 0.025 AND q1.n > 0 AND q2.n > 0 AND q2.n >= floor(q1.n * 0.85) AS accepted FROM q1 JOIN q2 USING (doc_id, page_number)),
pair AS (SELECT line_id, trim(string_agg(trim(text), ' ' ORDER BY seq)) AS candidate, avg(confidence) AS sure FROM second_ WHERE trim(text) <> '' GROUP BY line_id),
bare AS (SELECT f.*, o.kind, p.candidate, p.sure, length(regexp_replace(f.text, '[^\p{L}\p{M}\p{N}_]+', '', 'g')) AS n, regexp_matches(f.text, '[A-Za-z]{12,}') AS fused, o.whole FROM first_ f JOIN one o USING (line_id) LEFT JOIN pair p USING (line_id)),
line AS (SELECT *, (confidence < 0.90 OR fused) AND n > 0 AND candidate <> '' AND CASE WHEN whole OR kind IN (0, 3) THEN sure - confidence >= 0.08 OR (fused AND sure >= confidence AND length(candidate) - length(replace(candidate, ' ', '')) > length(text) - length(replace(text, ' ', '')))
  WHEN kind = 1 THEN sure - confidence >= 0.08 AND n >= 2 ELSE false END AS better FROM bare),
kept AS (SELECT l.doc_id, l.page_number, l.seq, CASE WHEN better THEN candidate ELSE text END AS text, better FROM line l JOIN page USING (doc_id, page_number) WHERE NOT accepted UNION ALL SELECT s.doc_id, s.page_number, s.seq, s.text, false FROM second_ s JOIN page USING (doc_id, page_number) WHERE accepted)
SELECT k.doc_id, CAST(k.page_number AS INTEGER) AS page_number, any_value(p.poor) AS read_again, any_value(p.accepted) AS accepted, count(*) AS n_lines, count(*) FILTER (better) AS n_retried, sha256(string_agg(text, chr(10) ORDER BY seq)) AS text_hash FROM kept k JOIN page p USING (doc_id, page_number) GROUP BY ALL"""


def _readings(spark, sf):
    """The two readings; the second was found on pages of 1,000 by 1,400 dots, turned by as many quarters as the document's id says and enlarged twofold, some of its lines in two pieces."""
    one = V.lines(spark, sf).withColumn("whole", (F.col("doc_id") + F.col("page_number")) % 3 == 0).withColumn("kind", (F.col("doc_id") + F.col("seq")) % 4)
    first = one.select("doc_id", "page_number", "seq", "line_id", F.when(F.col("kind") == 3, F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text")).alias("text"), "confidence", "normalized_bbox")
    same, kind = F.col("whole"), F.col("kind")
    text = F.when(same | kind.isin(0, 3), F.col("text")).when(kind == 1, F.concat("text", F.lit("ø"))).otherwise("ΩΩΩΩΩ")
    sure = F.when(same | kind.isin(0, 1), F.least(F.lit(1.0), F.col("confidence") + 0.1)).when(kind == 2, 0.0).otherwise(F.col("confidence"))
    two = one.select("doc_id", "page_number", "seq", text.alias("text"), sure.alias("confidence"), "normalized_bbox").withColumn("at", F.when(F.col("seq") % 5 == 0, F.instr("text", " ")).otherwise(0))
    split = F.col("at") > 0
    halves = F.when(split, F.array(F.struct(F.lit(0).alias("i"), F.substring(F.col("text"), F.lit(1), F.col("at") - 1).alias("t"), F.lit(100.0).alias("x1"), F.lit(500.0).alias("x2")), F.struct(F.lit(1).alias("i"), F.substring(F.col("text"), F.col("at") + 1, F.length("text")).alias("t"), F.lit(500.0).alias("x1"), F.lit(900.0).alias("x2"))))
    pieces = two.withColumn("p", F.explode(F.coalesce(halves, F.array(F.struct(F.lit(0).alias("i"), F.col("text").alias("t"), F.lit(100.0).alias("x1"), F.lit(900.0).alias("x2"))))))
    turns, w, h = (F.col("doc_id") % 4).cast("int"), 1000, 1400
    x1, x2, y1, y2 = F.col("p.x1"), F.col("p.x2"), F.get("normalized_bbox", F.lit(1)) * h, F.get("normalized_bbox", F.lit(3)) * h
    seen = F.when(turns == 0, F.array(x1, y1, x2, y2)).when(turns == 1, F.array(y1, w - x2, y2, w - x1)).when(turns == 2, F.array(w - x2, h - y2, w - x1, h - y1)).otherwise(F.array(h - y2, x1, h - y1, x2))
    again = pieces.select(
        "doc_id", "page_number", (F.col("seq") * 2 + F.col("p.i")).alias("seq"), F.concat_ws(":", "doc_id", "seq", "p.i").alias("line_id"), F.col("p.t").alias("text"), "confidence",
        F.transform(seen, lambda v: v * 2).alias("bbox"), turns.alias("turns"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(2.0).alias("scale"),
    )
    return staged(first), staged(readings.in_page(staged(again)).drop("bbox", "turns", "width", "height", "scale"))


def _by_page(kept, pages):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("retry_text", "text").alias("t")))), lambda s: s["t"]), "\n")
    per = kept.groupBy("doc_id", "page_number").agg(F.count("*").alias("n_lines"), F.count("retry_text").alias("n_retried"), F.sha2(text, 256).alias("text_hash"))
    judged = per.join(pages.select("doc_id", "page_number", "accepted"), ["doc_id", "page_number"], "left")
    return judged.select("doc_id", "page_number", F.col("accepted").isNotNull().alias("read_again"), F.coalesce("accepted", F.lit(False)).alias("accepted"), "n_lines", "n_retried", "text_hash")


@query(S.cte(S.LINES) + KEPT)
def second_readings(spark, sf):
    """Pages of all documents read twice: which reading is kept, and which lines have a better one beside them."""
    return _by_page(*readings.keep_better(*_readings(spark, sf)))


@query(r"""WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents),
l AS (SELECT *, CASE WHEN seq % 2 = 1 THEN replace(part, ' ', '') ELSE part END AS text, CASE WHEN seq % 3 = 0 THEN 0.7 ELSE 0.95 END::DOUBLE AS confidence FROM parts),
p AS (SELECT doc_id, avg(CASE WHEN confidence < 0.9 THEN 1 ELSE 0 END) >= 0.12 OR avg(CASE WHEN regexp_matches(text, '[A-Za-z]{12,}') THEN 1 ELSE 0 END) >= 0.04 AS poor FROM l GROUP BY doc_id),
f AS (SELECT l.*, poor AND doc_id % 2 = 0 AS finer FROM l JOIN p USING (doc_id)),
k AS (SELECT doc_id, seq, finer, CASE WHEN finer THEN part ELSE text END AS text, CASE WHEN finer THEN 0.95 ELSE confidence END AS confidence, part FROM f),
g AS (SELECT *, regexp_matches(text, '[A-Za-z]{12,}') AS fused, trim(part) AS candidate FROM k),
b AS (SELECT *, (confidence < 0.9 OR fused) AND candidate <> '' AND regexp_matches(text, '[\p{L}\p{N}_]') AND (0.95 - confidence >= 0.08 OR (fused AND length(candidate) - length(replace(candidate, ' ', '')) > length(text) - length(replace(text, ' ', '')))) AS better FROM g)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (better) AS n_retried, sha256(string_agg(CASE WHEN better THEN candidate ELSE text END, chr(10) ORDER BY seq)) AS text_hash FROM b GROUP BY doc_id""")
def pages_read_twice(spark, sf):
    """Each document's bytes as a page, through the three hooks: words joined at first, a finer reading that only even documents have, regions read again."""
    pages = V.table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.concat_ws("\n", F.col("doc_id").cast("string"), "text"), "UTF-8").alias("content"))
    line = lambda i, t, sure: {"text": t, "confidence": sure, "bbox": [0.0, float(i), 1.0, i + 1.0]}
    parts = lambda content: bytes(content).decode().split("\n")[1:]

    def read(content):
        return [line(i, t.replace(" ", "") if i % 2 else t, 0.95 if i % 3 else 0.7) for i, t in enumerate(parts(content))]

    def finer(content):
        even = int(bytes(content).split(b"\n", 1)[0]) % 2 == 0
        return [line(i, t, 0.95) for i, t in enumerate(parts(content))] if even else []

    def region(content, boxes):
        of = parts(content)
        return [[line(b[1], of[int(b[1])], 0.95)] for b in boxes]

    kept, _ = readings.read_twice(pages, read, finer, region)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("retry_text", "text").alias("t")))), lambda s: s["t"]), "\n")
    return kept.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.count("retry_text").alias("n_retried"), F.sha2(text, 256).alias("text_hash"))

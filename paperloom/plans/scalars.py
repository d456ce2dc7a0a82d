"""Queries of the column functions, on texts derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import keys as K
from paperloom.functions import text as X
from paperloom.operators import reconcile, segment, similarity
from paperloom.plans import sql as S
from paperloom.plans import views as V
from paperloom.plans.catalogue import query
from paperloom.plans.exchange import ESCAPED


def _one_of(key, *choices):
    """The choice that a key names, counted from 0."""
    return F.element_at(F.array(*[F.lit(c) if isinstance(c, str) else c for c in choices]), (key % len(choices) + 1).cast("int"))


@query("SELECT p_partkey, p_name || '|' || p_brand AS terms FROM part")
def removal_term_lists(spark, sf):
    written = F.concat(F.lit(" "), "p_name", F.lit(",, "), F.upper("p_name"), F.lit(";\n"), "p_brand", F.lit(" ,"), F.lower("p_brand"))
    return V.table(spark, sf, "part").select("p_partkey", F.array_join(X.removal_terms(written), "|").alias("terms"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '\b\d+(?:[.,]\d+)?\b'), '|') AS numbers FROM documents")
def number_lists(spark, sf):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(X.numbers(plain), "|").alias("numbers"))


@query("SELECT p_partkey, sha256(CAST(to_json({'p_brand': p_brand, 'p_name': p_name, 'p_size': p_size}) AS VARCHAR)) AS record_hash FROM part")
def canonical_hashes(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", K.canonical_hash("p_size", "p_name", "p_brand").alias("record_hash"))


@query("SELECT event_id, sha256(user_id || chr(0) || event_type || chr(0) || event_id) AS key FROM events")
def idempotency_keys(spark, sf):
    return V.table(spark, sf, "events").select("event_id", K.idempotency_key("user_id", "event_type", "event_id").alias("key"))


@query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN true WHEN item_id % 3 = 1 THEN regexp_matches(replace(text, ' ', ''), '[A-Za-z]{12,}') AND contains(text, ' ') ELSE false END AS better, true AS page_better FROM benchmark""")
def better_readings(spark, sf):
    """A second reading with the blanks restored, with more confidence, or with less."""
    k = F.col("item_id")
    pairs = V.table(spark, sf, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit("")).alias("original"), F.col("text").alias("candidate"), F.lit(0.6).alias("original_confidence"), _one_of(k, F.lit(0.7), F.lit(0.6), F.lit(0.59)).alias("candidate_confidence"))
    line = reconcile.better_reading(pairs).select("item_id", "better")
    page = reconcile.better_reading(pairs.withColumn("candidate_confidence", F.lit(0.65)), page=True).select("item_id", F.col("better").alias("page_better"))
    return line.join(page, "item_id")


@query(f"SELECT doc_id, sha256({ESCAPED}) AS escaped_hash FROM documents")
def markdown_escaped(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(X.escape_markdown("text"), 256).alias("escaped_hash"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Paper ' || doc_id WHEN 1 THEN 'b_' || doc_id WHEN 2 THEN 'document' WHEN 3 THEN '_CON' WHEN 4 THEN 'a_b_c' || doc_id WHEN 5 THEN 'é' || doc_id WHEN 6 THEN left(repeat('x', 200), 120) ELSE 'v1.2' END AS stem FROM documents""")
def safe_stems(spark, sf):
    n = F.col("doc_id").cast("string")
    name = _one_of(F.col("doc_id"), F.concat(F.lit("  Paper   "), n, F.lit(".pdf")), F.concat(F.lit("C:\\a/b?"), n, F.lit(".png")), "a/", "CON.txt", F.concat(F.lit('a<b|c'), n, F.lit(". .")), F.concat(F.lit("e\u0301"), n, F.lit(".md")), F.concat(F.repeat(F.lit("x"), F.lit(200)), F.lit(".pdf")), "v1.2.tar")
    return V.table(spark, sf, "documents").select("doc_id", X.safe_stem(name).alias("stem"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id + 100 AS VARCHAR) WHEN 1 THEN CAST(doc_id + 100 AS VARCHAR) WHEN 2 THEN CAST(doc_id + 100 AS VARCHAR) ELSE '1.5' END AS number, CASE doc_id % 4 WHEN 0 THEN 'one, two: ' || doc_id WHEN 1 THEN 'end. Next' WHEN 2 THEN 'twice, so' ELSE 'a b' END AS text FROM documents""")
def tidied(spark, sf):
    d, n = F.col("doc_id"), (F.col("doc_id") + 100).cast("string")
    number = _one_of(d, F.concat(F.lit("."), n), F.concat(n, F.lit(".")), F.concat(F.lit(" "), n, F.lit("  ·")), "1.5")
    text = _one_of(d, F.concat(F.lit("one ,two : "), d.cast("string")), "end.Next", "twice,, so", "a   b")
    return V.table(spark, sf, "documents").select("doc_id", X.tidy_table_number(number).alias("number"), X.tidy_punctuation(text).alias("text"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Short Not on>short note on' WHEN 1 THEN 'the the>the' ELSE '' END AS hints FROM documents""")
def grammar_hints(spark, sf):
    text = _one_of(F.col("doc_id"), F.concat(F.lit("Write a Short Not on "), F.col("source")), "over the the hill", "nothing here")
    hints = F.transform(X.grammar_hints(text), lambda h: F.concat(h["original"], F.lit(">"), h["suggested"]))
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(hints, ",").alias("hints"))


FORMULAS = (
    ("$$x + {}$$", None), ("  ", "empty"), (r"\[ a $ b {} \]", "math_delimiter"), ("(a + {}", "brackets"), (r"\begin{matrix} a & {} \end{pmatrix}", "environments"), (r"\href{x}{{}}", "unsafe_command"), (r"\documentclass{a{}}", "unsafe_command"),
    (r"a \\ {}", "line_break"), ("a & {}", "alignment"), ("a % {}", "comment"), ("a{}_", "incomplete_script"), (r"\begin{matrix} a & {} \\ b & c \end{matrix}", None), (r"\frac{a}{{}} \unheard", "unsupported_command"), (r"\begin{odd} {} \end{odd}", "unsupported_environment"),
)


@query(f"SELECT doc_id, [{', '.join('NULL' if v is None else repr(v) for _, v in FORMULAS)}][doc_id % {len(FORMULAS)} + 1] AS verdict FROM documents")
def formula_verdicts(spark, sf):
    n = F.col("doc_id").cast("string")
    formula = _one_of(F.col("doc_id"), *[F.replace(F.lit(f), F.lit("{}"), n) for f, _ in FORMULAS])
    return V.table(spark, sf, "documents").select("doc_id", X.formula_verdict(X.strip_formula(formula), commands=("frac",), environments=("matrix", "pmatrix")).alias("verdict"))


@query(r"""WITH p AS (SELECT page_id, '<p onclick="go()">' || html || '<img src=a><SCRIPT>x</SCRIPT></p>' AS html FROM pages)
SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', '', 'gis'), '<style\b.*?</style\s*>', '', 'gis'), '<img\b[^>]*>', '', 'gis'), '\s+on\w+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'gis')) AS html_hash FROM p""")
def html_sanitised(spark, sf):
    html = F.concat(F.lit('<p onclick="go()">'), "html", F.lit("<img src=a><SCRIPT>x</SCRIPT></p>"))
    return V.table(spark, sf, "pages").select("page_id", F.sha2(X.sanitise_html(html), 256).alias("html_hash"))


@query("""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row FROM documents), w AS (SELECT doc_id, row, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS col FROM d)
SELECT doc_id AS page_id, CASE WHEN doc_id % 7 IN (0, 2) THEN row + 1 ELSE row END AS row, col, trim(regexp_replace(word, '\\s+', ' ', 'g')) AS text, CAST(NULL AS VARCHAR) AS error FROM w WHERE doc_id % 7 <> 1 AND doc_id % 7 <> 3 AND doc_id % 7 <> 4
UNION ALL SELECT doc_id, 0, 0, 'over all', NULL FROM documents WHERE doc_id % 7 IN (0, 2) UNION ALL SELECT doc_id, NULL, NULL, NULL, CASE doc_id % 7 WHEN 1 THEN 'malformed' WHEN 3 THEN 'span' ELSE 'overlap' END FROM documents WHERE doc_id % 7 IN (1, 3, 4)""")
def text_cells(spark, sf):
    """Whole texts as tables, a row for each line and a cell for each word; in some a cell spans a row of its own, holds a table, or has a span that cannot be."""
    word = lambda w: F.concat(F.lit("<td>"), F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    rows = F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(line, " "), word), "\n"), F.lit("</TR>")))
    spread = F.lit('<tr><th colspan="3">over&#32;<b>all</b></th></tr>')
    first = _one_of(F.col("doc_id"), spread, "<tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr>", spread, '<tr><td rowspan="0">x</td></tr>', '<tr><td>a</td><td rowspan="2">b</td></tr><tr><td colspan=2>c</td></tr>', "", "<!-- <td> -->")
    pages = V.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<p>no table</p><TABLE border=1>"), first, F.array_join(rows, ""), F.lit("</TABLE>")).alias("html"))
    return reconcile.extract_cells(pages).select("page_id", "row", "col", "text", "error")


CELL_ROWS = """, g AS (SELECT DISTINCT doc_id, page_number FROM lines), c AS (SELECT *, unnest(range(6)) AS i FROM g), t AS (SELECT doc_id AS page_id, CAST(page_number AS INTEGER) AS table_index, CAST(i // 3 AS INTEGER) AS row, i % 3 AS col, CASE WHEN (doc_id + i) % 4 = 0 THEN '' ELSE 'cell ' || i END AS t FROM c)
"""


def _flat_cells(spark, sf):
    return V.cells(spark, sf).select(F.col("doc_id").alias("page_id"), "table_index", "row", "col", "row_span", "col_span", "text", F.lit(None).cast("string").alias("error"))


@query(S.cte(S.LINES) + CELL_ROWS + "SELECT page_id, table_index, row, '| ' || string_agg(t, ' | ' ORDER BY col) || ' |' AS markdown FROM t GROUP BY ALL")
def cell_markdown(spark, sf):
    return reconcile.cell_grid(_flat_cells(spark, sf))


@query(S.cte(S.LINES) + CELL_ROWS + """, r AS (SELECT page_id, table_index, row, '  <tr>' || chr(10) || string_agg('    ' || CASE row WHEN 0 THEN '<th' || CASE WHEN page_id % 9 = 0 AND col = 0 THEN ' colspan="2"' ELSE '' END || '>' || t || '</th>' ELSE '<td>' || t || '</td>' END, chr(10) ORDER BY col) || chr(10) || '  </tr>' AS r FROM t GROUP BY ALL)
SELECT page_id, table_index, '<table>' || chr(10) || string_agg(r, chr(10) ORDER BY row) || chr(10) || '</table>' AS html FROM r GROUP BY ALL""")
def cell_html(spark, sf):
    return reconcile.cell_html(_flat_cells(spark, sf))


@query("""WITH k AS (SELECT doc_id, ['decorative', 'chart', 'table', 'equation', 'diagram', 'figure'][doc_id % 6 + 1] AS kind, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS seen FROM documents)
SELECT doc_id, CASE kind WHEN 'decorative' THEN 0.95 WHEN 'chart' THEN 0.62 WHEN 'table' THEN 0.68 WHEN 'equation' THEN 0.55 ELSE 0.5 END::DOUBLE AS confidence, kind = 'decorative' AS empty, CASE WHEN kind = 'decorative' THEN false ELSE contains(' ' || seen || ' ', ' ') AND seen <> '' END AS names_text FROM k""")
def alternative_texts(spark, sf):
    d = V.table(spark, sf, "documents")
    seen = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    kind = _one_of(F.col("doc_id"), "decorative", "chart", "table", "equation", "diagram", "figure")
    data = F.create_map(F.lit("chart_type"), F.lit("bar chart"), F.lit("rows"), F.lit("3"), F.lit("columns"), F.lit("2"))
    made = d.select("doc_id", seen.alias("seen"), X.alternative_text(kind, seen, F.lit(""), data).alias("a"))
    return made.select("doc_id", "a.confidence", (F.col("a.text") == "").alias("empty"), ((F.col("seen") != "") & F.contains("a.text", "seen")).alias("names_text"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '<non-structured log line redacted>' ELSE '2024-01-02 03:04:05,678 ' || CASE event_id % 4 WHEN 1 THEN 'INFO' WHEN 2 THEN 'ERROR' ELSE 'DEBUG' END || ' app.' || event_type || ' <message redacted>' END AS line FROM events")
def logs_redacted(spark, sf):
    e = F.col("event_id")
    line = F.concat(F.lit("2024-01-02 03:04:05,678 "), _one_of(e, "NOTE", "INFO", "ERROR", "DEBUG"), F.lit(" app."), "event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" said so"))
    return V.table(spark, sf, "events").select("event_id", X.redact_log(line).alias("line"))


WORDS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z]{4,}')"


@query(f"""WITH u AS (SELECT w AS word, count(*) * 100 AS n FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY w), t AS (SELECT DISTINCT unnest(list_transform({WORDS}, lambda x: replace(x, 'e', 'c'))) AS token FROM benchmark),
o AS (SELECT token, coalesce(n, 0) AS own_n FROM t LEFT JOIN u ON word = token WHERE length(token) >= 4), m AS (SELECT token, own_n, word, n, row_number() OVER (PARTITION BY token ORDER BY n DESC, word) AS r, coalesce(lead(n) OVER (PARTITION BY token ORDER BY n DESC, word), 0) AS next_n FROM o JOIN u ON n >= 5000 AND token <> word AND abs(length(token) - length(word)) <= 1 AND levenshtein(token, word) <= 1 WHERE own_n < 5000)
SELECT token, word AS corrected FROM m WHERE r = 1 AND n >= next_n * 10 AND n >= own_n * 10""")
def spelling(spark, sf):
    words = F.explode(F.regexp_extract_all(X.fold("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    known = V.table(spark, sf, "documents").select(words.alias("word")).groupBy("word").agg((F.count("*") * 100).alias("n"))
    tokens = V.table(spark, sf, "benchmark").select(words.alias("token")).select(F.replace("token", F.lit("e"), F.lit("c")).alias("token"))
    return reconcile.correct_spelling(tokens, known)


@query("""WITH h AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_number, count(*) AS k FROM lineitem GROUP BY ALL), n AS (SELECT doc_id, sum(k) FILTER (page_number <> 2) AS votes FROM h GROUP BY doc_id)
SELECT h.doc_id, h.page_number, 'Annual papcr of order ' || h.doc_id AS original, 'Annual paper of order ' || h.doc_id AS corrected, CAST(votes AS BIGINT) AS votes FROM h JOIN n USING (doc_id) WHERE page_number = 2 AND votes >= 2""")
def header_slips(spark, sf):
    """Pages of an order carry its header; the second page spells it wrong."""
    pages = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number")).agg(F.count("*").alias("k"))
    slip = F.col("page_number") == 2
    text = F.concat(F.when(slip, "Annual papcr of order ").otherwise("Annual paper of order "), F.col("doc_id").cast("string"))
    lines = pages.select("doc_id", "page_number", F.explode(F.sequence(F.lit(1), F.when(slip, F.lit(1)).otherwise(F.col("k")).cast("int"))).alias("seq"), text.alias("text"), F.when(slip, 0.8).otherwise(0.9).alias("confidence"), F.array(F.lit(0.1), F.lit(0.05), F.lit(0.9), F.lit(0.08)).alias("normalized_bbox"))
    return similarity.header_consensus(lines).drop("seq")


@query(S.cte(S.LINES) + """, m AS (SELECT doc_id, page_number, line_id, seq, (y1 + y2) / 2 + 0.005 AS my, y2 FROM lines WHERE seq % 13 = 5 AND y2 + 0.005 < 0.94)
SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, 'm' || seq AS mark_line_id, line_id, '07' AS mark FROM m""")
def mark_neighbours(spark, sf):
    """Marks in the margin, a fifth of a line's distance below the lines that they belong to."""
    rows = V.lines(spark, sf).select("doc_id", "page_number", "line_id", "seq", F.concat(F.lit("t "), "text").alias("text"), "normalized_bbox")
    at = lambda i: F.get("normalized_bbox", F.lit(i)) + 0.005
    marks = rows.filter("seq % 13 = 5").filter(at(3) < 0.94).select("doc_id", "page_number", F.concat(F.lit("m"), "seq").alias("line_id"), "seq", F.lit("7").alias("text"), F.array(F.lit(0.85), at(1), F.lit(0.9), at(3)).alias("normalized_bbox"))
    return reconcile.attach_margin_marks(rows.union(marks))


@query(r"""WITH d AS (SELECT doc_id, '# the title' || chr(10) || 'Source file: the.pdf' || chr(10) || '$$' || chr(10) || 'the = 1' || chr(10) || '$$' || chr(10) || '![the map](the.png)' || chr(10) || 'a the, b' || chr(10) || '- the.' || chr(10) || 'other ' || doc_id AS t FROM documents)
SELECT doc_id, '# the title' || chr(10) || 'Source file: the.pdf' || chr(10) || '$$' || chr(10) || 'the = 1' || chr(10) || '$$' || chr(10) || '![map](the.png)' || chr(10) || 'a, b' || chr(10) || '' || chr(10) || 'other ' || doc_id AS markdown, CAST(3 AS BIGINT) AS removed FROM d""")
def markdown_removal(spark, sf):
    lines = ["# the title", "Source file: the.pdf", "$$", "the = 1", "$$", "![the map](the.png)", "a the, b", "- the.", "other "]
    docs = V.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("\n".join(lines)), F.col("doc_id").cast("string")).alias("markdown"))
    return segment.remove_from_markdown(docs, ["the"])


SPELLED = """WITH ws AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z]+') AS w FROM documents), b AS (SELECT w[i] AS first, w[i + 1] AS second, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM ws) GROUP BY ALL),
u AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(w) AS w FROM ws) GROUP BY w), sp AS (SELECT replace(word, 'e', 'c') AS token, min(word) AS corrected FROM u WHERE n >= 2 AND length(word) >= 4 AND contains(word, 'e') GROUP BY ALL),
l AS (SELECT item_id, replace(text, 'e', 'c') AS t FROM benchmark WHERE NOT contains(text, '=')), x AS (SELECT item_id, t, regexp_extract_all(t, '[A-Za-z]+(?:[''-][A-Za-z]+)*|[^A-Za-z]+') AS p FROM l), e AS (SELECT item_id, p, i, p[i] AS token FROM (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS i FROM x)),
f AS (SELECT item_id, i, token, corrected, lower(list_filter(p[1:i - 1], lambda y: regexp_matches(y, '^[A-Za-z]'))[-1]) AS before, lower(list_filter(p[i + 1:], lambda y: regexp_matches(y, '^[A-Za-z]'))[1]) AS after FROM e JOIN sp USING (token)),
s AS (SELECT f.*, coalesce(ln(1 + s1.n), 0) + coalesce(ln(1 + s2.n), 0) AS stands, coalesce(ln(1 + c1.n), 0) + coalesce(ln(1 + c2.n), 0) AS speaks FROM f LEFT JOIN b s1 ON s1.first = before AND s1.second = token LEFT JOIN b s2 ON s2.first = token AND s2.second = after LEFT JOIN b c1 ON c1.first = before AND c1.second = corrected LEFT JOIN b c2 ON c2.first = corrected AND c2.second = after),
j AS (SELECT *, stands = 0 OR speaks > stands + ln(3) AS taken, speaks > stands + ln(3) AS better FROM s),
n AS (SELECT e.item_id, string_agg(coalesce(j.corrected, e.token), '' ORDER BY e.i) AS text, min(CASE WHEN better THEN 0.95 ELSE 0.9 END) FILTER (j.i IS NOT NULL) AS confidence, count(j.i) AS k FROM e LEFT JOIN j ON j.item_id = e.item_id AND j.i = e.i AND taken GROUP BY e.item_id)
SELECT item_id, 'line' AS kind, sha256(text) AS text_hash, confidence::DOUBLE AS confidence FROM n WHERE k > 0 UNION ALL SELECT item_id, 'review', sha256(token || '>' || corrected), NULL FROM j WHERE NOT taken"""


@query(SPELLED)
def spelling_in_lines(spark, sf):
    words = F.regexp_extract_all(X.fold("text"), F.lit("[a-z]+"), F.lit(0))
    known, bigrams = _spoken(V.table(spark, sf, "documents").select(words.alias("w")))
    often = known.filter("n >= 2 and length(word) >= 4 and contains(word, 'e')")
    spelled = often.groupBy(F.replace("word", F.lit("e"), F.lit("c")).alias("token")).agg(F.min("word").alias("corrected"))
    lines = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("line_id"), F.replace("text", F.lit("e"), F.lit("c")).alias("text"))
    corrected, reviews = reconcile.correct_lines(lines, spelled, bigrams)
    return corrected.select(F.col("doc_id").alias("item_id"), F.lit("line").alias("kind"), F.sha2("text", 256).alias("text_hash"), "confidence").union(reviews.select("doc_id", F.lit("review"), F.sha2(F.concat("token", F.lit(">"), "suggested"), 256), F.lit(None).cast("double")))


@query(r"""WITH RECURSIVE ws AS (SELECT regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z]+') AS w FROM documents), u AS (SELECT word, log10(n) + 9 - log10(sum(n) OVER ()) AS level FROM (SELECT unnest(w) AS word, count(*) AS n FROM ws GROUP BY 1)),
b AS (SELECT w[i] AS first, w[i + 1] AS second, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM ws) GROUP BY ALL), j AS (SELECT regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z]+') AS w FROM benchmark),
t AS (SELECT DISTINCT w[i] || w[i + 1] AS token FROM (SELECT w, unnest(range(1, len(w))) AS i FROM j) WHERE length(w[i] || w[i + 1]) >= 12), a AS (SELECT token FROM t LEFT JOIN u ON word = token WHERE coalesce(level, 0) < 1.5),
s AS (SELECT token, a, unnest(range(a + 1, least(length(token), a + 24) + 1)) AS b FROM (SELECT token, unnest(range(length(token))) AS a FROM a)), x AS (SELECT token, a, b, substr(token, a + 1, b - a) AS word FROM s),
e AS (SELECT token, a, b, word, level FROM x JOIN u USING (word) WHERE word IN ('a', 'i', 'of', 'to', 'in', 'on', 'at', 'by', 'or', 'as', 'is', 'it', 'an', 'be') OR (length(word) >= 3 AND level >= 3)),
l AS (SELECT e.token, e.b, f.b AS c, e.word AS first, f.word AS second, f.level + ln(1 + n) / 4 AS more FROM e JOIN e f ON f.token = e.token AND f.a = e.b JOIN b ON b.first = e.word AND b.second = f.word),
p AS (SELECT token, b, word AS last, level AS score, word AS suggested, 1 AS k FROM e WHERE a = 0 UNION ALL SELECT p.token, l.c, l.second, p.score + l.more, p.suggested || ' ' || l.second, p.k + 1 FROM p JOIN l ON l.token = p.token AND l.b = p.b AND l.first = p.last WHERE k < 5),
r AS (SELECT token, suggested, score, lead(score) OVER o AS next, row_number() OVER o AS r FROM p WHERE k >= 2 AND b = length(token) WINDOW o AS (PARTITION BY token ORDER BY score DESC, suggested))
SELECT token, suggested, round(score, 6) AS score, next IS NULL OR score >= next + 2.5 AS taken FROM r WHERE r = 1""")
def joined_words(spark, sf):
    """Neighbouring words of the items, joined, and parted again by what the documents know; the SQL goes through every parting."""
    words = lambda name: V.table(spark, sf, name).select(F.regexp_extract_all(X.fold("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    known, pairs = _spoken(words("documents"))
    each = words("benchmark").select(F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, b))).alias("token"))
    return reconcile.split_joined(each.filter("token is not null"), known, pairs).withColumn("score", F.round("score", 6))


def _spoken(texts):
    """How often each word, and each two neighbouring words, stand in the texts (w: array of words)."""
    known = texts.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    two = F.arrays_zip("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("v"))
    return known, texts.select(F.explode(two).alias("p")).select(F.col("p.w").alias("first"), F.col("p.v").alias("second")).filter("second is not null").groupBy("first", "second").agg(F.count("*").alias("n"))


@query(S.cte(S.LINES) + r""", w AS (SELECT doc_id, seq, regexp_extract_all(replace(text, ' a ', ' a A '), '[\p{L}\p{M}\p{N}_]+|[ \t\n\f\r]+|[^\p{L}\p{M}\p{N}_ \t\n\f\r]') AS t FROM lines),
i AS (SELECT doc_id, seq, t, list_filter(range(1, len(t) - 1), lambda i: regexp_matches(t[i], '^[A-Za-z]+$') AND regexp_matches(t[i + 1], '^[ \t\n\f\r]+$') AND lower(t[i]) = lower(t[i + 2]))[1] AS i FROM w)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, t[i] || t[i + 1] || t[i + 2] AS original, t[i] AS suggested FROM i WHERE i IS NOT NULL""")
def words_said_twice(spark, sf):
    """Hints in all lines of all documents, in which the word a is said once more."""
    rows = V.lines(spark, sf).select("doc_id", F.col("seq").cast("long").alias("seq"), F.explode(X.grammar_hints(F.replace("text", F.lit(" a "), F.lit(" a A ")))).alias("h"))
    return rows.select("doc_id", "seq", "h.original", "h.suggested")


@query(S.cte(S.LINES) + r""", l AS (SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN '2024-01-02 03:04:05,678  INFO ' WHEN 2 THEN '2024-01-02T03:04 12 ERROR   app. ' ELSE '2024-01-02 03:04 TRACE ' END || text AS line FROM lines), h AS (SELECT doc_id, seq, regexp_extract(line, '^\d{4}-\d{2}-\d{2}[^ ]* [^ ]+[ \t\n\f\r]+(?:DEBUG|INFO|WARNING|ERROR|CRITICAL)[ \t\n\f\r]+[^ ]+') AS head FROM l)
SELECT doc_id, count(*) FILTER (head <> '') AS n_known, sha256(string_agg(CASE WHEN head = '' THEN '<non-structured log line redacted>' ELSE regexp_replace(head, '[ \t\n\f\r]+', ' ', 'g') || ' <message redacted>' END, chr(10) ORDER BY seq)) AS log_hash FROM h GROUP BY doc_id""")
def text_logs_redacted(spark, sf):
    """All lines of all documents as messages of a log, under heads of four forms, two of which are known."""
    head = _one_of(F.col("seq"), "", "2024-01-02 03:04:05,678  INFO ", "2024-01-02T03:04 12 ERROR   app. ", "2024-01-02 03:04 TRACE ")
    rows = V.lines(spark, sf).select("doc_id", "seq", X.redact_log(F.concat(head, "text")).alias("line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id").agg(F.count_if(F.endswith("line", F.lit("<message redacted>"))).alias("n_known"), F.sha2(whole, 256).alias("log_hash"))


SPOILED = r"replace(replace(replace(text, ', ', '  ,,'), '. ', '.'), ': ', ' ::')"


@query(rf"""WITH s AS (SELECT doc_id, {SPOILED} AS t FROM documents), a AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, '[ \t]+([,;:!?])', '\1', 'g'), '([,;:!?])([A-Za-z])', '\1 \2', 'g') AS u FROM s),
b AS (SELECT doc_id, t, regexp_replace(u, '([a-z])\.([A-Z])', '\1. \2', 'g') AS u FROM a)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, ',,+', ',', 'g'), ';;+', ';', 'g'), '::+', ':', 'g'), '[ \t][ \t]+', ' ', 'g')) AS tidied_hash, t <> regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, ',,+', ',', 'g'), ';;+', ';', 'g'), '::+', ':', 'g'), '[ \t][ \t]+', ' ', 'g') AS changed FROM b""")
def texts_tidied(spark, sf):
    """Whole texts with blanks put before marks, marks doubled and blanks after stops taken out, tidied again."""
    spoiled = F.col("text")
    for found, instead in ((", ", "  ,,"), (". ", "."), (": ", " ::")):
        spoiled = F.replace(spoiled, F.lit(found), F.lit(instead))
    tidy = V.table(spark, sf, "documents").select("doc_id", spoiled.alias("spoiled"), X.tidy_punctuation(spoiled).alias("tidied"))
    return tidy.select("doc_id", F.sha2("tidied", 256).alias("tidied_hash"), (F.col("spoiled") != F.col("tidied")).alias("changed"))

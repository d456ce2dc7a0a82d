from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import segment

LINE = "doc_id long, seq int, line_id string, page_number int, text string, confidence double, normalized_bbox array<double>"


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), LINE)


def test_numbers_marks_and_boxes(spark):
    df = lines(
        spark,
        (1, 0, "p0001-l00001", 1, "1(a) Explain the term. (5 marks)", 0.9, [0.1, 0.1, 0.8, 0.15]),
        (1, 1, "p0001-l00002", 1, "Use one real example.", 0.8, [0.1, 0.2, 0.7, 0.23]),
        (1, 2, "p0002-l00001", 2, "2. Calculate the mass. [6]", 0.7, [0.1, 0.1, 0.8, 0.2]),
    )
    out = {r["display_number"]: r for r in segment.segment_questions(df).collect()}
    assert set(out) == {"1(a)", "2"}
    assert (out["1(a)"]["marks"], out["2"]["marks"]) == (5, 6)
    assert out["1(a)"]["source_bbox"] == [0.1, 0.1, 0.8, 0.23] and out["1(a)"]["source_line_ids"] == ["p0001-l00001", "p0001-l00002"]
    assert out["2"]["source_page"] == 2 and out["1(a)"]["question_id"] == "q-1-a" and out["1(a)"]["ocr_confidence"] == 0.85
    assert out["1(a)"]["text"] == "Explain the term. (5 marks) Use one real example."


def test_unnumbered_documents_repeated_ids_and_preamble(spark):
    df = lines(spark, (1, 0, "a", 1, "One plain line", 0.9, None), (1, 1, "b", 1, " ", None, None), (2, 0, "c", 1, "Read this", 0.9, None), (2, 1, "d", 1, "1. x", 0.9, None), (2, 2, "e", 1, "1. y", 1.9, None), (3, 0, None, 1, None, None, None))
    out = {(r["doc_id"], r["question_id"]): r for r in segment.segment_questions(df).collect()}
    assert set(out) == {(1, "q-unstructured-1"), (2, "q-1"), (2, "q-1-2"), (3, "q-unstructured-1")}
    assert out[1, "q-unstructured-1"]["source_line_ids"] == ["a", "b"] and out[2, "q-1-2"]["ocr_confidence"] is None
    assert {(r["doc_id"], r["warning"]) for r in segment.segmentation_warnings(df).collect()} >= {(1, "unnumbered"), (2, "preamble")}
    assert segment.segment_questions(df.limit(0)).count() == 0


def test_answers_follow_their_numbers(spark):
    q = spark.createDataFrame([(1, "q1", "1"), (1, "q2", "2(a)"), (2, "only", "7")], "script_id int, question_id string, display_number string")
    r = spark.createDataFrame([(1, 0, "l0", 1, "before", 0.5), (1, 1, "l1", 1, "1. Inertia keeps a body", 0.91), (1, 2, "l2", 1, "at rest", 0.91), (1, 3, "l3", 2, "9. unknown number", 0.91), (1, 4, "l4", 2, "2 (a): next", None), (2, 0, "m0", 1, "no number at all", 0.8)], "script_id int, seq int, line_id string, page int, text string, ocr_confidence double")
    out = {(x["script_id"], x["question_id"]): x for x in segment.align_answers(q, r).collect()}
    assert out[1, "q1"]["response_line_ids"] == ["l1", "l2", "l3"] and out[1, "q1"]["alignment_confidence"] == 0.95 and out[1, "q1"]["ocr_confidence"] == 0.91
    assert out[1, "q2"]["response_line_ids"] == ["l4"] and out[1, "q2"]["ocr_confidence"] is None and out[2, "only"]["alignment_confidence"] == 0.75


def test_paragraph_lines_join_by_geometry(spark):
    df = lines(spark, (1, 0, "a", 1, "first line", 0.9, [0.1, 0.30, 0.9, 0.32]), (1, 1, "b", 1, "goes on", 0.8, [0.1, 0.33, 0.9, 0.35]), (1, 2, "c", 1, "2. new", 0.9, [0.1, 0.36, 0.9, 0.38]), (1, 3, "d", 1, "far below", 0.9, [0.1, 0.8, 0.9, 0.82]))
    out = segment.join_paragraph_lines(segment.classify_exam_lines(df)).orderBy("paragraph").collect()
    assert [r["line_ids"] for r in out] == [["a", "b"], ["c"], ["d"]] and out[0]["confidence"] == 0.8 and out[1]["type"] == "question"


def test_text_functions(spark):
    one = lambda c, *v: spark.createDataFrame([tuple(v)], ", ".join(f"c{i} string" for i in range(len(v)))).select(c.alias("x")).first()["x"]
    assert one(X.normalise_question("c0"), "Été, le_2 Straße!") == "été le 2 strasse"
    assert one(X.shingles("c0"), "a b c d") == ["a b c", "b c d"] and one(X.shingles("c0"), "a b") == ["a b"] and one(X.shingles("c0"), "!") == []
    assert one(X.numbers("c0"), "masses 10 kg, 12.5 kg") == ["10", "12.5"]
    assert one(X.word_error_rate("c0", "c1"), "the cat sat down", "the dog sat") == 0.5 and one(X.character_error_rate("c0", "c1"), "abcd", "abxd") == 0.25
    assert one(X.removal_terms("c0"), "Draft, copy; draft\nCOPY , x") == ["Draft", "copy", "x"]
    assert one(X.remove_terms("c0", ["draft"]), "a Draft here, drafty") == "a here, drafty" and one(X.count_terms("c0", ["draft"]), "Draft drafty draft.") == 2
    assert one(X.tidy_punctuation("c0"), "a ,b;;c.D  e") == "a, b; c. D e" and one(X.tidy_table_number("c0"), "·1234") == "1234"
    assert one(X.escape_markdown("c0"), "<a_*[x]>") == "&lt;a&#95;&#42;&#91;x&#93;&gt;" and one(X.safe_stem("c0"), "..\\dir/CON.pdf") == "_CON"
    assert one(X.safe_csv_cell("c0"), " =1+1") == "' =1+1" and one(X.slug("c0"), "1(a)") == "q-1-a"
    assert one(X.sanitise_html("c0"), '<p onclick="x()">a<script>b</script><img src=x></p>') == "<p>a</p>"
    assert one(X.formula_verdict(X.strip_formula("c0")), "$$\\frac{a}{b}$$") is None
    for bad, why in (("{a", "brackets"), ("\\input{x}", "unsafe_command"), ("", "empty"), ("\\begin{a}x", "environments"), ("a & b", "alignment"), ("x_", "incomplete_script")):
        assert one(X.formula_verdict(X.strip_formula("c0")), bad) == why
    assert one(X.redact_log("c0"), "2026-01-02 10:00:00,123 INFO app.core secret") == "2026-01-02 10:00:00,123 INFO app.core <message redacted>"
    assert [h["suggested"] for h in one(X.grammar_hints("c0"), "Write a short not on on it")] == ["short note on", "on"]
    df = spark.createDataFrame([("chart", "x y", "", {"trend": "up", "axes": "t, v"})], "k string, v string, c string, d map<string,string>")
    assert df.select(X.alternative_text("k", "v", "c", "d").alias("a")).first()["a"]["text"] == "A chart. Axes or measures: t, v. Reported pattern: up. Visible text includes: x y."


def test_positional_and_handling_accuracy(spark):
    df = spark.createDataFrame([(["1", "2", "3"], ["1", "x"], 4, 3)], "e array<string>, a array<string>, n int, m int")
    r = df.select(X.positional_accuracy(F.col("e"), F.col("a")).alias("p"), X.handling_accuracy(F.col("n"), F.col("m")).alias("h")).first()
    assert r["p"] == 0.333333 and r["h"] == 0.75

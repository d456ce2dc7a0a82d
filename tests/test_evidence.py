import hashlib
import hmac
import base64
import math
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import keys as K
from paperloom.operators import curriculum, datasets, enrich, governance, jobs, overlays, reconcile, reports, similarity
from paperloom.plans import catalogue

LINE = "doc_id long, seq int, line_id string, page_number int, text string, confidence double, normalized_bbox array<double>"


def test_approved_fresh_overlays_replace_text(spark):
    lines = spark.createDataFrame([(1, 0, "a", 1, "teh", 0.62, [0.1, 0.1, 0.9, 0.2]), (1, 1, "b", 1, "ok", 0.94, [2.0, 0.0, 1.0, 1.0]), (1, 2, "c", 1, "x", None, None)], LINE)
    c = spark.createDataFrame(
        [(1, "c1", "block", "a", "block text", "approved", 1, False), (1, "c2", "line", "a", "the", "approved", 1, False), (1, "c3", "line", "b", "no", "draft", 1, False), (1, "c4", "line", "c", "no", "approved", 1, True)],
        "doc_id long, correction_id string, target_kind string, target_id string, replacement string, status string, version int, stale boolean",
    )
    out = {r["line_id"]: r for r in overlays.effective_lines(lines, c).collect()}
    assert (out["a"]["text"], out["a"]["raw_text"], out["a"]["corrected"], out["a"]["confidence_band"]) == ("the", "teh", True, "low")
    assert out["b"]["text"] == "ok" and out["b"]["normalized_bbox"] is None and out["b"]["confidence_band"] == "high" and out["c"]["confidence_band"] == "unavailable" and not out["c"]["corrected"]
    assert overlays.reconstructed_text(overlays.effective_lines(lines, c), c).first()["text"] == "the\nok\nx"
    assert {r["line_id"] for r in overlays.review_issues(overlays.effective_lines(lines, c)).collect()} == {"a", "c"}
    bad = c.withColumn("reason", F.lit("")).withColumn("target_id", F.lit("gone"))
    assert {(r["correction_id"], r["rule"]) for r in overlays.validate_corrections(bad, lines).collect()} == {(f"c{i}", rule) for i in range(1, 5) for rule in ("reason", "missing_target")}


def test_packs_and_cells_keep_whole_texts(spark, monkeypatch):
    long = "word " * 60
    q = spark.createDataFrame([(d, 0, "q", f"{long}{end}") for d, end in ((2, "a"), (4, "b"))], "doc_id long, group_no int, question_id string, text string").withColumns({"topic": F.lit("t"), "difficulty": F.lit("low")})
    monkeypatch.setattr(catalogue.V, "questions", lambda *_: q)
    packs = catalogue.student_pack(spark, "").collect()
    assert [r["n_items"] for r in packs] == [1, 1] and len({r["items_hash"] for r in packs}) == 2
    url = "https://example.org/" + "/".join(f"part{i}" for i in range(20))
    monkeypatch.setattr(catalogue.V, "table", lambda *_: spark.createDataFrame([(1, "", url)], "page_id long, html string, url string"))
    cells = [str(r.asDict(recursive=True)) for r in catalogue.page_cells(spark, "").collect()]
    assert all(any(f"'{part}'" in c for c in cells) for part in url.split("/"))


def test_search_without_its_row_and_headers_of_any_line(spark, monkeypatch):
    monkeypatch.setattr(catalogue.V, "table", lambda *_: spark.createDataFrame([(5, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert catalogue.vector_topk(spark, "").count() == 0
    texts = ["Physics Examination", "Physics Examination", "Physlcs Examination"]
    rows = [(1, 40 * i + 15, f"l{i}", i + 1, t, 0.9, [0.1, 0.1, 0.9, 0.12]) for i, t in enumerate(texts)]
    monkeypatch.setattr(catalogue.V, "lines", lambda *_: spark.createDataFrame(rows, LINE))
    assert [(r["original"], r["corrected"]) for r in catalogue.header_consensus(spark, "").collect()] == [(texts[2], texts[0])]


def test_present_but_null_override_wins(spark):
    df = spark.createDataFrame([({"topic": "x"}, {"topic": None}), ({"topic": "x"}, {}), ({"topic": "x"}, None)], "ai map<string,string>, teacher_override map<string,string>")
    assert [r["t"] for r in df.select(overlays.effective_value("topic").alias("t")).collect()] == [None, "x", "x"]


def test_duplicates_report_changed_numbers(spark):
    q = spark.createDataFrame([(1, "Find the force on a mass of 10 kg when it moves"), (2, "Find the force on a mass of 12 kg when it moves"), (3, "find the FORCE on a mass of 10 kg, when it moves"), (4, "Something else"), (5, "")], "question_key long, text string")
    out = {(r["left_key"], r["right_key"]): r for r in similarity.duplicate_questions(q, 0.4).collect()}
    assert set(out) == {(1, 2), (1, 3)} and out[1, 2]["changed_numbers"] and out[1, 3]["score"] == 1.0 and not out[1, 3]["changed_numbers"] and "find the force" in out[1, 2]["shared_phrases"]
    with pytest.raises(ValueError):
        similarity.duplicate_questions(q, 0)


def test_prefix_filter_finds_what_brute_force_finds(spark):
    import random

    rng = random.Random(4)
    sets = [(i, sorted({f"t{rng.randint(0, 14)}" for _ in range(rng.randint(1, 9))})) for i in range(120)]
    df = spark.createDataFrame(sets, "question_key long, items array<string>")
    for t in (0.3, 0.55, 0.8, 1.0):
        got = {(r["left_key"], r["right_key"]) for r in similarity.prefix_pairs(df, t).collect()}
        want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= t}
        assert got == want


def test_pairs_of_many_texts_equal_brute_force(spark, monkeypatch):
    draw = random.Random(5)
    base = [[f"w{draw.randrange(40)}" for _ in range(n)] for n in (3, 8, 20, 60)]
    texts = []
    for _ in range(60):
        words = list(draw.choice(base))
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(40)}"
        texts.append(" ".join(words))
    rows = list(enumerate([*texts, "", "...", texts[0].upper()])) + [(None, texts[1])]
    runs = lambda t: {tuple(t.split()[i : i + 3]) for i in range(max(len(t.split()) - 2, 1))}
    first = {}
    for i, t in reversed(list(enumerate(texts))):
        first[t] = i
    expected = {(first[t], i, 1.0) for i, t in enumerate([*texts, "", "", texts[0]]) if t and first[t] != i}
    for a, i in first.items():
        for b, j in first.items():
            score = len(runs(a) & runs(b)) / len(runs(a) | runs(b))
            if i < j and score >= 0.55:
                expected.add((i, j, round(score, 4)))
    df = spark.createDataFrame(rows, "question_key long, text string")
    found = lambda: similarity.duplicate_pairs(df).collect()
    assert {(r["left_key"], r["right_key"], r["score"]) for r in found()} == expected
    monkeypatch.setattr(similarity, "KEYS_SENT", 0)
    assert {(r["left_key"], r["right_key"], r["score"]) for r in found()} == expected and len(found()) == len(expected)


def test_vectors_rank_by_meaning(spark):
    t = spark.createDataFrame([(1, "motion acceleration force"), (2, "poetry rhyme metaphor")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "force acceleration motion")], "query_id long, text string")
    out = similarity.search_semantic(t, q, 5).orderBy("rank").collect()
    assert out[0]["doc_id"] == 1 and out[0]["score"] == 1.0


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.5, 0.5], [0.25, 0.25, 0.75, 0.75], [0.0, 0.0, 4.0, 0.0, 4.0, 2.0, 0.0, 2.0])], "a array<double>, b array<double>, p array<double>")
    r = df.select(G.iou("a", "b").alias("iou"), G.overlap_ratio("a", "b").alias("o"), G.box_of("p").alias("box"), G.normalised("p", F.lit(8), F.lit(2)).alias("n"), G.turned_back("a", F.lit(2), F.lit(1.0), F.lit(1.0)).alias("t")).first()
    assert round(r["iou"], 6) == round(0.0625 / 0.4375, 6) and r["o"] == 0.25 and r["box"] == [0, 0, 4, 2] and r["n"] == [0, 0, 0.5, 1.0] and r["t"] == [0.5, 0.5, 1.0, 1.0]


def test_reconciliation_accounts_for_lines(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}", 1, t, 0.95, [0.1, i / 10, 0.9, i / 10 + 0.05]) for i, t in enumerate(("prose", "cell text", "fig label", "x=1", " "))], LINE)
    elements = spark.createDataFrame([(1, 1, "f", "figure", [0.0, 0.2, 1.0, 0.26]), (1, 1, "m", "formula", [0.0, 0.3, 1.0, 0.33])], "doc_id long, page_number int, element_id string, type string, normalized_bbox array<double>")
    found = reconcile.dispositions(lines, elements, lines.filter("line_id = 'l1'").select("doc_id", "line_id"))
    assert {r["line_id"]: r["disposition"] for r in found.collect()} == {"l0": "prose", "l1": "table_cell", "l2": "figure_label", "l3": "verified_duplicate", "l4": "unresolved"}
    c = reconcile.content_coverage(found).first()
    assert (c["raw_line_count"], c["coverage_percent"], c["status"]) == (5, 80.0, "failed")
    after = reconcile.content_coverage(reconcile.remove_lines(found, lines.filter("line_id = 'l4'"))).first()
    assert after["status"] == "passed" and after["n_user_removed"] == 1


def test_tables(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 1, 1, "mass", [0.1, 0.1, 0.5, 0.2], True), (1, 1, 0, 1, 0, 1, 1, 1, "", [0.5, 0.1, 0.9, 0.2], True)], "doc_id long, page_number int, table_index int, cell_index int, row int, col int, row_span int, col_span int, text string, normalized_bbox array<double>, geometry_normalized boolean")
    lines = spark.createDataFrame([(1, 0, "l0", 1, "mass", 0.99, [0.12, 0.12, 0.4, 0.18]), (1, 1, "l1", 1, "kg", 0.99, [0.55, 0.12, 0.7, 0.18])], LINE)
    assert {(r["line_id"], r["cell_index"]) for r in reconcile.assign_lines_to_cells(lines, cells).collect()} == {("l0", 0), ("l1", 1)}
    tables = spark.createDataFrame([(1, 0, True, 0.9)], "doc_id long, table_index int, geometry_normalized boolean, bbox_identity_score double")
    v = reconcile.verify_tables(tables, cells, lines, least_quality=0.8).first()
    assert v["status"] == "accepted" and v["source_coverage"] == 1.0 and v["text_agreement"] == 1.0
    over = cells.withColumn("col", F.lit(0))
    assert reconcile.table_geometry(over).first()["geometry_score"] == 0.4  # 0.65 + 0.25 + 0.1 - 0.25 - 0.35
    grid = reconcile.clean_integer_rows(spark.createDataFrame([(1, 0, 0, i, t) for i, t in enumerate((".12", "34", "·567", "x"))], "doc_id long, table_index int, row int, col int, text string"))
    assert sorted(r["text"] for r in grid.collect()) == ["12", "34", "567", "x"]


def test_html_cells_with_spans(spark):
    html = '<p>x</p><table><tr><td colspan="2">head</td><td rowspan=2>side</td></tr><tr><td>a&amp;b</td><td>c</td></tr></table><table><tr><th>k</th><th>v</th></tr></table>'
    out = reconcile.extract_cells(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert {(r["table_index"], r["row"], r["col"], r["text"]) for r in out.collect()} == {(0, 0, 0, "head"), (0, 0, 2, "side"), (0, 1, 0, "a&b"), (0, 1, 1, "c"), (1, 0, 0, "k"), (1, 0, 1, "v")}
    assert {r["markdown"] for r in reconcile.cell_grid(out).filter("table_index = 0").collect()} == {"| head |  | side |", "| a&b | c |  |"}
    assert reconcile.extract_cells(spark.createDataFrame([(1, html)], "page_id long, html string"), most=3).first()["error"] == "too_many_cells"


def test_neighbouring_repeats_go(spark):
    e = spark.createDataFrame([(1, 1, 0, "A heading of words", [0.1, 0.1, 0.9, 0.2]), (1, 1, 1, "A heading of  words.", [0.1, 0.1, 0.9, 0.2]), (1, 1, 2, "A heading of words", [0.1, 0.5, 0.9, 0.6])], "doc_id long, page_number int, seq int, content string, normalized_bbox array<double>")
    assert [r["seq"] for r in reconcile.suppress_adjacent_duplicates(e).orderBy("seq").collect()] == [1, 2]


def test_headers_agree_across_pages(spark):
    rows = [(1, i, f"l{i}", p, t, c, [0.1, 0.05, 0.9, 0.1]) for i, (p, t, c) in enumerate(((1, "Physics Paper One", 0.9), (2, "Physics Paper One", 0.95), (3, "Physlcs Paper One", 0.7)))]
    out = similarity.header_consensus(spark.createDataFrame(rows, LINE)).collect()
    assert [(r["original"], r["corrected"], r["votes"]) for r in out] == [("Physlcs Paper One", "Physics Paper One", 2)]


def test_better_readings(spark):
    p = spark.createDataFrame([("thequickbrownfox", 0.8, "the quick brown fox", 0.8), ("hello wor1d", 0.7, "hello world", 0.8), ("hello", 0.7, "other", 0.99)], "original string, original_confidence double, candidate string, candidate_confidence double")
    assert sorted((r["original"], r["better"]) for r in reconcile.better_reading(p).collect()) == [("hello", False), ("hello wor1d", True), ("thequickbrownfox", True)]


def test_spelling_by_deletions(spark):
    t = spark.createDataFrame([("acceleratlon",), ("force",), ("xq",)], "token string")
    u = spark.createDataFrame([("acceleration", 90_000), ("force", 80_000), ("forge", 6_000)], "word string, n long")
    assert [tuple(r) for r in reconcile.correct_spelling(t, u).collect()] == [("acceleratlon", "acceleration")]


def test_labels_releases_and_splits(spark):
    r = spark.createDataFrame([(1, "A", "verified", 1), (1, "B", "verified", 2), (1, "A", "rejected", 3), (2, "A", "verified", 1), (2, "A", "verified", 2), (3, "A", "rejected", 1)], "item_id long, reviewer string, decision string, seq int")
    assert {x["item_id"]: x["state"] for x in datasets.label_state(r).collect()} == {1: "gold", 2: "silver", 3: "rejected"}
    ids = spark.range(60).select(F.col("id").cast("string").alias("id")).withColumn("m", K.digest_mod_10("id"))
    assert all(x["m"] == int(hashlib.sha256(x["id"].encode()).hexdigest(), 16) % 10 for x in ids.collect())
    items = spark.createDataFrame([(1, "p", True, False), (2, "p", True, True), (3, "q", False, False)], "item_id long, project_id string, contains_student_data boolean, deidentified boolean")
    good, bad = datasets.admit_items(items, spark.createDataFrame([("p", "active")], "project_id string, status string"))
    assert [r["item_id"] for r in good.collect()] == [2] and {r["item_id"]: r["reason"] for r in bad.collect()} == {1: "not_deidentified", 3: "project_closed"}


def test_pseudonyms_are_those_of_the_standard_library(spark):
    for key in (b"short", b"k" * 70):
        r = spark.createDataFrame([("t", f"Ana-{i}é") for i in range(20)], "t string, i string").select("i", K.pseudonym(key, "t", "i").alias("p")).collect()
        for x in r:
            digest = hmac.new(key, f"t\0{x['i']}".encode(), hashlib.sha256).digest()[:12]
            assert x["p"] == "learner-" + base64.b32encode(digest).decode().rstrip("=").lower()


def test_audit_chain_links_and_breaks(spark):
    e = spark.createDataFrame([("t", i, f"b{i}") for i in range(5)] + [("u", 0, "x")], "tenant string, sequence long, body string")
    chained = governance.chain_audit(e)
    assert governance.verify_audit_chain(chained).count() == 0
    broken = chained.withColumn("event_hash", F.when((F.col("tenant") == "t") & (F.col("sequence") == 2), "z").otherwise(F.col("event_hash")))
    assert [r["sequence"] for r in governance.verify_audit_chain(broken).collect()] == [3]


def test_scope_hides_what_is_not_ones_own(spark):
    r = spark.createDataFrame([(1, "note", "t", "me", "private", "c"), (2, "note", "t", "you", "private", "c"), (3, "note", "u", "me", "tenant", "c"), (4, "note", "t", "you", "tenant", None), (5, "note", "t", "you", "tenant", "d"), (6, "student_progress", "t", "you", "tenant", "c")], "resource_id int, resource_type string, tenant_id string, created_by string, visibility string, course_id string").withColumn("unit_id", F.lit(None).cast("string"))
    ids = lambda df: sorted(x["resource_id"] for x in df.collect())
    assert ids(governance.apply_scope(r, "t", "me", ("c",))) == [1, 4, 6] and ids(governance.apply_scope(r, "t", "me", ("c",), student=True)) == [1, 4]


def test_fan_out_retries_and_leases(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b")], "event_id int, action string")
    s = spark.createDataFrame([(7, ["a"]), (8, ["*", "a"])], "subscription_id int, event_types array<string>")
    assert sorted(map(tuple, governance.fan_out(e, s).collect())) == [(1, 7), (1, 8), (2, 8)]
    assert [r["s"] for r in spark.range(10).select(K.backoff_seconds("id").alias("s")).collect()] == [15, 30, 60, 120, 240, 480, 960, 1920, 3600, 3600]
    t = datetime(2026, 1, 1)
    leases = spark.createDataFrame([("a", "claimed", t), ("b", "claimed", datetime(2027, 1, 1)), ("c", "claimed", None), ("d", "done", t)], "job_id string, status string, lease_expires_at timestamp")
    assert sorted(r["job_id"] for r in jobs.expired_leases(leases, datetime(2026, 6, 1)).collect()) == ["a", "c"]


def test_curriculum_rules(spark):
    o = spark.createDataFrame([(1, "CS-1", "One", "d", None, [], []), (2, "CS-2", "Two", "d", "CS-1", ["CS-1"], []), (3, "cs-1", "Again", "d", None, [], []), (4, "", "x", "d", None, [], []), (5, "CS-5", "F", "d", "NO", ["NO2"], ["NO3"])], "row int, stable_code string, title string, description string, parent_code string, prerequisites array<string>, replaces array<string>")
    assert {tuple(r) for r in curriculum.validate_objectives(o).collect()} == {(3, "duplicate_code"), (4, "required_field"), (5, "unknown_parent"), (5, "unknown_prerequisite"), (5, "unknown_replacement")}
    n = spark.createDataFrame([("a", None), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "zz"), ("b", "a")], "node_id string, parent_id string")
    assert {tuple(r) for r in curriculum.tree_check(n).collect()} == {("b", "duplicate"), ("c", "cycle"), ("d", "cycle"), ("e", "unknown_parent")}
    rub = spark.createDataFrame([("ok", [("a", 60.0), ("b", 40.0)]), ("bad", [("a", 60.0), ("a", -1.0)])], "rubric_id string, criteria array<struct<id:string,weight:double>>")
    assert {tuple(r) for r in curriculum.validate_rubrics(rub).collect()} == {("bad", "duplicate_id"), ("bad", "negative_weight"), ("bad", "total")}


def test_model_rows_must_be_grounded(spark):
    q = spark.createDataFrame([(1, "q-1", "text", 1, ["a", "b"], True), (1, "q-2", "text", 1, ["c"], False)], "doc_id long, question_id string, text string, source_page int, source_line_ids array<string>, consent boolean")

    def fails(batch):
        raise RuntimeError

    def answer(batch):
        return batch.assign(topic="t", difficulty="low")[["question_key", "question_id", "source_page", "source_line_ids", "topic", "difficulty"]]

    out = enrich.enrich_questions(q, fails, answer).collect()
    assert [(r["question_id"], r["verdict"], r["model"]) for r in out] == [("q-1", "ok", "fallback")]
    ai = spark.createDataFrame([(1, "q-1", 1, ["a"], "t", "low"), (1, "q-2", 2, ["c"], "t", "low"), (1, "q-9", 1, ["a"], "t", "low")], "doc_id long, question_id string, ai_source_page int, ai_source_line_ids array<string>, topic string, difficulty string")
    assert {r["question_id"]: r["verdict"] for r in enrich.validate_grounding(q, ai).collect()} == {"q-1": "ok", "q-2": "wrong_page", "q-9": "unknown_question"}


def test_perfect_case_scores_one(spark):
    e = spark.createDataFrame([("x", "a b c", ["1", "2"], ["l1", "l2"], 1, 2, 0)], "case_id string, text string, question_numbers array<string>, reading_order array<string>, tables int, figures int, equations int")
    ask = "array<struct<question_id:string,source_page:int,source_line_ids:array<string>,ai:struct<question_id:string,source_page:int,source_line_ids:array<string>>>>"
    a = spark.createDataFrame([("x", "a b c", ["1", "2"], ["l1", "l2"], 1, 2, 0, [("q", 1, ["l1"], ("q", 1, ["l1"]))])], f"case_id string, full_text string, display_numbers array<string>, line_order array<string>, n_tables int, n_figures int, n_equations int, questions {ask}")
    r = reports.score_cases(e, a).first().asDict()
    assert r["character_error_rate"] == r["word_error_rate"] == 0 and all(r[k] == 1.0 for k in r if k.endswith(("accuracy", "traceability", "grounding_rate")))
    assert reports.score_cases(e, a.limit(0)).first()["error"] == "missing_result"


def test_search_ranks_all_texts_as_plain_python_does(spark):
    import math

    sf = "/root/testdata/sf0.001"
    texts, queries = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))

    def vector(text):
        import re

        v = [0.0] * 128
        for w in re.findall(r"[\w'-]{2,}", (text or "").lower().replace("ß", "ss")):
            d = hashlib.blake2b(w.encode(), digest_size=16).digest()
            v[int.from_bytes(d[:4], "big") % 128] += 1.0 if d[4] & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    known = [(d, vector(t)) for d, t in texts]
    found = {}
    for r in similarity.search_semantic(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "query_id"), 10).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    for i, t in queries:
        q = vector(t)
        best = sorted((round(sum(a * b for a, b in zip(q, v)), 6) for _, v in known if any(a and b for a, b in zip(q, v))), reverse=True)[:10]
        assert [found[i][k + 1] for k in range(len(best))] == pytest.approx(best, abs=2e-6)


def test_table_function_agrees_with_the_job(spark):
    html = '<table><tr><td colspan="2">head</td><td rowspan=2>side</td></tr><tr><td>a&amp;b</td><td>c</td></tr></table><table><tr><th>k</th><th>v</th></tr></table>'
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string")
    spark.udtf.register("html_cells_of_test", reconcile.html_cells)
    pages.createOrReplaceTempView("pages_of_test")
    lateral = spark.sql("select page_id, c.* from pages_of_test, lateral html_cells_of_test(html) c").collect()
    job = reconcile.extract_cells(pages).collect()
    pick = lambda rows: sorted((r["page_id"], r["table_index"], r["row"], r["col"], r["row_span"], r["col_span"], r["text"]) for r in rows)
    assert pick(lateral) == pick(job) and len(lateral) == 6


def test_trees_of_any_depth(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(700)]
    odd = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("lost", "nobody"), ("child", "lost"), ("self", "self"), ("n5", "n4")]
    found = {(r["node_id"], r["rule"]) for r in curriculum.tree_check(spark.createDataFrame(chain + odd, "node_id string, parent_id string")).collect()}
    assert found == {("a", "cycle"), ("b", "cycle"), ("c", "cycle"), ("d", "cycle"), ("self", "cycle"), ("lost", "unknown_parent"), ("n5", "duplicate")}


def test_scopes_of_many_principals_equal_those_of_each(spark):
    resources = spark.createDataFrame([(i, f"t{i % 2}", [None, "m", "p"][i % 3], ["private", "tenant", None][i % 3 if i % 5 else 0], f"u{i % 4}", "x") for i in range(60)], "resource_id long, tenant_id string, course_id string, visibility string, created_by string, resource_type string").withColumn("unit_id", F.lit(None).cast("string"))
    people = [("u0", "t0", ["m"]), ("u1", "t1", ["*"]), ("u2", "t0", ["m", "p", "m"]), ("u3", "t1", ["*", "m"]), ("u4", "t0", [])]
    found = {(r["subject"], r["resource_id"]) for r in governance.apply_scopes(resources, spark.createDataFrame(people, "subject string, tenant_id string, courses array<string>")).collect()}
    rows = governance.apply_scopes(resources, spark.createDataFrame(people, "subject string, tenant_id string, courses array<string>")).count()
    each = {(s, r["resource_id"]) for s, t, c in people if c for r in governance.apply_scope(resources, t, s, c).collect()}
    assert found == each and rows == len(found)


def test_subscriptions_give_each_pair_once(spark):
    events = spark.createDataFrame([(1, "view"), (2, "click"), (3, "other")], "event_id long, action string")
    subs = spark.createDataFrame([(1, ["view", "*"]), (2, ["click", "click"]), (3, [])], "subscription_id long, event_types array<string>")
    assert sorted(tuple(r) for r in governance.fan_out(events, subs).collect()) == [(1, 1), (2, 1), (2, 2), (3, 1)]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_word_errors_of_any_length(spark):
    from paperloom.functions import text as X

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert X.edits(a, b) == plain_edits(a, b)
    long = [f"w{i}" for i in range(25_000)]
    changed = [w for i, w in enumerate(long) if i % 500] + ["more"] * 7
    some = [rng.choice(long[:40]) for _ in range(1500)], [rng.choice(long[:40]) for _ in range(1400)]
    pairs = [(" ".join(long), " ".join(long)), (" ".join(long), " ".join(changed)), (" ".join(some[0]), " ".join(some[1])), ("a b c", "a b d"), ("a b", None), ("", "a"), (None, "a"), (" ".join(long), None), (" ".join(long), "")]
    found = [r[0] for r in spark.createDataFrame(pairs, "e string, a string").select(X.word_error_rate("e", "a")).collect()]
    assert found == [0.0, round(57 / 25_000, 6), pytest.approx(round(plain_edits(*some) / 1500, 6)), round(1 / 3, 6), 1.0, None, None, 1.0, 1.0]


def test_formula_delimiters_go_to_the_last(spark):
    from paperloom.functions import text as X

    formulas = {"$$ x $$": "x", r"\( \[ $ $$ \(\[ y \]\) $$ $ \] \)": "y", "$" * 14 + "z" + "$" * 14: "z", "$a$ + $b$": "a$ + $b", "$": "$", "$$": "", "$$\r\n\\frac{a}{b}\r$$": r"\frac{a}{b}", "(a)": "(a)", "": ""}
    rows = spark.createDataFrame(list(formulas.items()), "c string, e string").select("c", "e", X.strip_formula("c").alias("s")).collect()
    assert {r["c"]: r["s"] for r in rows} == formulas
    assert spark.createDataFrame([(r"\begin{odd} x \end{odd}",)], "c string").select(X.formula_verdict("c", environments=X.MATH_ENVIRONMENTS)).first()[0] == "unsupported_environment"


def test_tables_that_cannot_be_are_errors(spark):
    bad = {
        "<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>": "malformed", "<table><tr><td>a<td>b</td></tr></table>": "malformed", "<table><td>a</td></table>": "malformed", "<table><tr><td>a": "malformed",
        "<table><tr><td>a</tr><tr></td></table>": "malformed", "<table><tr><td rowspan=0>a</td></tr></table>": "span", '<table><tr><td colspan="two">a</td></tr></table>': "span", "<table><tr><td colspan=-1>a</td></tr></table>": "span",
        '<table><tr><td>a</td><td rowspan="2">b</td></tr><tr><td colspan="2">c</td></tr></table>': "overlap", "<table><tr><td rowspan='400' colspan='400'>a</td></tr></table>": "too_many_cells",
    }
    for html, why in bad.items():
        found = reconcile.extract_cells(spark.createDataFrame([(1, html + "<table><tr><td>good &lt;b&gt;</td></tr></table>")], "page_id long, html string")).collect()
        assert found[0]["error"] == why and found[0]["col"] is None
        assert [r["text"] for r in found[1:]] == ([] if why == "too_many_cells" or not html.endswith("</table>") else ["good <b>"])
    none = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x</p>"), (4, "<table></table>")], "page_id long, html string")
    assert reconcile.extract_cells(none).count() == 0


def test_chains_are_verified_wherever_ranges_end(spark):
    rows = [(t, i, f"h{t}-{i}", None if i == 0 else f"h{t}-{i - 1}" if i % 17 else "broken") for t in (0, 1, None) for i in range(300)]
    events = spark.createDataFrame(rows, "tenant long, sequence long, event_hash string, previous_hash string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = governance.verify_audit_chain(events.repartition(3))
        windows = re.findall(r"windowspecdefinition\(tenant#\w+, (\w+)#", found._jdf.queryExecution().toString())
        assert windows and set(windows) == {"range_of_its_own"}  # none over a whole chain
        bad = {(r["tenant"], r["sequence"], r["expected_previous"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert bad == {(t, i, f"h{t}-{i - 1}") for t, i, _, previous in rows if previous == "broken"}


def test_spans_that_fill_a_worker_are_an_error(spark):
    html = '<table><tr><td rowspan="1000000" colspan="9">x</td></tr></table>'
    assert reconcile.extract_cells(spark.createDataFrame([(1, html)], "page_id long, html string")).first()["error"] == "too_many_cells"


def test_manifest_tree_is_as_deep_as_the_count_asks(spark):
    items = spark.range(70_000).select(F.col("id").alias("item_id"), F.col("id").alias("source_document_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_sha256"), F.lit("gold").alias("state"))
    one, two = (datasets.release_manifest(x).first() for x in (items, items.repartition(3)))
    assert one == two and one["item_count"] == 70_000 and one["releasable"] and one["n_train"] + one["n_test"] + one["n_validation"] == 70_000
    assert datasets.release_manifest(items.limit(0)).first()["releasable"] is False


def test_header_votes_equal_those_of_all_pairs_of_pages(spark):
    from difflib import SequenceMatcher

    rng = random.Random(11)
    kinds = ["Physics Paper One", "Annual Examination 2024", "Question Booklet A", "--------", "Answer all questions!"]
    noisy = lambda t: "".join(rng.choice("xlo1 ") if rng.random() < 0.06 else c for c in t)
    rows = [(d, 10 * p + i, f"l{d}-{p}-{i}", p, noisy(rng.choice(kinds)) if rng.random() < 0.6 else rng.choice(kinds), rng.randint(5, 9) / 10, [0.1, 0.05, 0.9, 0.1]) for d in (1, 2) for p in range(18) for i in range(3)]
    found = {tuple(r) for r in similarity.header_consensus(spark.createDataFrame(rows, LINE).repartition(3)).collect()}
    bare = lambda t: re.sub(r"\W+", "", t).lower()
    top = [(d, p, seq, t.strip(), c) for d, seq, _, p, t, c, _ in rows if 8 <= len(t.strip()) <= 100]
    expected = set()
    for d, p, seq, t, c in top:
        votes: dict = {}
        for d2, p2, _, t2, c2 in top:
            if d2 == d and p2 != p and SequenceMatcher(None, bare(t), bare(t2)).ratio() >= 0.84:
                n, sure = votes.get(t2, (0, 0))
                votes[t2] = (n + 1, max(sure, c2))
        if votes:
            n, sure, t2 = max((n, sure, t2) for t2, (n, sure) in votes.items())
            if t2 != t and n >= 2 and sure >= c:
                expected.add((d, p, seq, t, t2, n))
    assert found == expected and len(expected) > 10


def test_headers_of_a_very_long_document(spark):
    """5,000 pages of one document: their common headers, and one on each page that no other has."""
    rng = random.Random(12)
    own = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz0123456789", 24)) for _ in range(5000)]
    near = similarity.similar_spellings(spark.createDataFrame([(1, x) for x in own[:500]], "doc_id long, bare string")).collect()
    assert {(r["b1"], r["b2"]) for r in near} == {(x, x) for x in own[:500]}
    texts = ["Annual report of the ministry", "Annual rep0rt of the ministry", "Annual report of the rninistry"]
    rows = [(1, p, f"l{p}", p, texts[0] if p % 50 else texts[1 + p // 50 % 2], 0.9 if p % 50 else 0.5, [0.1, 0.05, 0.9, 0.1]) for p in range(5000)]
    found = similarity.header_consensus(spark.createDataFrame(rows, LINE)).collect()
    assert len(found) == 100 and {r["corrected"] for r in found} == {texts[0]} and {r["votes"] for r in found} == {4900}


def test_joined_words_are_parted(spark):
    words = [("the", 50_000), ("quick", 900), ("brown", 800), ("quickbrown", 1), ("answer", 5000), ("question", 4000), ("quest", 400), ("ion", 300), ("in", 90_000), ("international", 700), ("inter", 50), ("national", 900), ("recieve", 2)]
    pairs = [("answer", "the", 40), ("the", "question", 90), ("the", "quest", 1), ("quest", "ion", 1), ("quick", "brown", 30), ("inter", "national", 5)]
    u, b = spark.createDataFrame(words, "word string, n long"), spark.createDataFrame(pairs, "first string, second string, n long")
    tokens = spark.createDataFrame([("answerthequestion",), ("answerthequestion",), ("international",), ("zzzzzzzzzzzzzz",), ("thequick",), ("Answerthequestion",), (None,)], "token string")
    found = {r["token"]: (r["suggested"], r["taken"]) for r in reconcile.split_joined(tokens, u, b).collect()}
    assert set(found) == {"answerthequestion"}
    words_of = {"answerthequestion": ["answer the question", "answer the quest ion"]}
    total = sum(n for _, n in words)
    level = lambda w: math.log10(dict(words)[w]) + 9 - math.log10(total)
    score = lambda t: sum(map(level, t.split())) + sum(math.log1p(n) / 4 for a, c in zip(t.split(), t.split()[1:]) for x, y, n in pairs if (x, y) == (a, c))
    one, two = sorted(words_of["answerthequestion"], key=score, reverse=True)
    assert found["answerthequestion"] == (one, score(one) >= score(two) + reconcile.AHEAD)
    assert reconcile.split_joined(tokens.limit(0), u, b).count() == 0


def test_lines_keep_their_expressions(spark):
    spelling = spark.createDataFrame([("forcc", "force"), ("mascs", "mass")], "token string, corrected string")
    joined = spark.createDataFrame([("answerthequestion", "answer the question", True), ("quickbrownfoxes", "quick brown foxes", False)], "token string, suggested string, taken boolean")
    texts = ["the forcc is forcc = mascs a where mascs counts", "= forcc mascs", "forcc answerthequestion here", "quickbrownfoxes run", "plain"]
    lines = spark.createDataFrame([(1, str(i), t) for i, t in enumerate(texts)], "doc_id long, line_id string, text string")
    none = spark.createDataFrame([], "first string, second string, n long")
    corrected, reviews = reconcile.correct_lines(lines, spelling, none, joined)
    assert {r["line_id"]: (r["text"], r["confidence"]) for r in corrected.collect()} == {"0": ("the force is forcc = mascs a where mass counts", 0.9), "2": ("force answer the question here", 0.9)}
    assert [(r["line_id"], r["token"], r["suggested"]) for r in reviews.collect()] == [("3", "quickbrownfoxes", "quick brown foxes")]


def test_mappings_equal_those_of_every_shared_word(spark):
    rng = random.Random(21)
    words = [f"word{i}" for i in range(80)]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.06)), 79)] for _ in range(n))
    sources = [(i, text(rng.randint(1, 30))) for i in range(25)] + [(100, None), (101, ""), (102, "none shares this"), (103, "word79 word78"), (104, text(400))]
    objectives = [(i, text(rng.randint(1, 120))) for i in range(150)] + [(200 + i, "word1 word2 word3") for i in range(6)] + [(300, None), (301, "")]
    found = similarity.suggest_mappings(spark.createDataFrame(sources, "source_id long, text string"), spark.createDataFrame(objectives, "objective_id long, text string"), 4)
    expected = {}
    for i, t in sources:
        x = set((t or "").split())
        x = {w for w in x if len(w) >= 3}
        scored = sorted((-len(x & set((u or "").split())) / len(x | set((u or "").split())), o) for o, u in objectives if x & set((u or "").split()))
        expected |= {(i, o): (r + 1, pytest.approx(-s, abs=6e-5)) for r, (s, o) in enumerate(scored[:4])}
    assert {(r["source_id"], r["objective_id"]): (r["rank"], r["score"]) for r in found.collect()} == expected


def test_scopes_are_counted_before_they_meet(spark):
    rows = [(i, t, c, s, v) for i, (t, c, s, v) in enumerate([("t", "c", "a", "tenant"), ("t", "c", "b", None), ("t", "c", "a", "private"), ("t", None, "a", "private"), ("t", None, "b", "tenant"), ("u", "c", "a", "tenant"), ("t", "d", None, "private"), ("t", "d", "a", "tenant")] * 50)]
    resources = spark.createDataFrame(rows, "resource_id int, tenant_id string, course_id string, created_by string, visibility string")
    principals = spark.createDataFrame([("a", "t", ["c"]), ("b", "t", ["*"]), ("x", "t", ["c", "d", "c"]), ("a", "u", ["c"]), ("y", "v", ["*"])], "subject string, tenant_id string, courses array<string>")
    pick = lambda df: sorted(tuple(r) for r in df.collect())
    counted = governance.scope_counts(resources, principals)
    assert pick(counted) == pick(governance.apply_scopes(resources, principals).groupBy("subject").agg(F.count("*").alias("n"))) == [("a", 300), ("b", 200), ("x", 200)]


def test_long_texts_are_alike_by_all_their_characters(spark):
    from difflib import SequenceMatcher

    words = "the line of the page that a reader has read twice and that is long enough".split()
    rng = random.Random(6)
    one = " ".join(rng.choice(words) for _ in range(300))
    two = re.sub("[rd]", "x", one)
    bare = one.replace(" ", ""), two.replace(" ", "")
    assert SequenceMatcher(None, *bare).ratio() < 0.55 <= SequenceMatcher(None, *bare, autojunk=False).ratio()
    pairs = spark.createDataFrame([(one, two, 0.7, 0.8), (one, "q" * len(one), 0.7, 0.8)], "original string, candidate string, original_confidence double, candidate_confidence double")
    assert [r["better"] for r in reconcile.better_reading(pairs, page=True).collect()] == [True, False]
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        for least in (0.55, 0.72):
            assert similarity.ratio_reaches(a, b, least) == (SequenceMatcher(None, a, b, autojunk=False).ratio() >= least)


def test_tables_take_blocks_without_python(spark):
    box = lambda low, high: [0.1, low, 0.9, high]
    tables = [(1, 1, 0, box(0.1, 0.3)), (1, 1, 1, box(0.1, 0.3)), (1, 1, 2, box(0.8, 0.9)), (2, 1, 0, box(0.1, 0.2)), (3, 1, 0, box(0.1, 0.2)), (4, 1, 0, None), (4, 1, 1, box(0.1, 0.2)), (5, 1, 5, box(0.1, 0.3))]
    blocks = [(1, 1, 7, box(0.1, 0.25)), (1, 1, 8, box(0.1, 0.29)), (2, 1, 4, box(0.7, 0.8)), (4, 1, 1, box(0.1, 0.2)), (5, 1, 3, box(0.1, 0.2)), (5, 1, 2, box(0.1, 0.2)), (6, 1, 1, box(0.0, 1.0))]
    rows = lambda data, name: spark.createDataFrame(data, f"doc_id long, page_number int, {name} int, normalized_bbox array<double>")
    made = reconcile.match_tables_to_blocks(rows(tables, "table_index"), rows(blocks, "block_index"))
    found = sorted(((r["doc_id"], r["table_index"], r["block_index"], round(r["score"], 6)) for r in made.collect()), key=lambda r: r[:2])
    assert found == [(1, 0, 8, 0.95), (1, 1, 7, 0.75), (1, 2, None, 0.0), (2, 0, 4, 0.5), (3, 0, None, 0.0), (4, 0, None, 0.0), (4, 1, 1, 1.0), (5, 5, 2, 0.5)]
    assert "InPandas" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_few_spellings_meet_without_an_index(spark, monkeypatch):
    from difflib import SequenceMatcher

    rng = random.Random(7)
    rows = [(d, "".join(rng.choice("abcd") for _ in range(rng.randint(8, 14)))) for d in range(4) for _ in range(20)]
    spellings = spark.createDataFrame(sorted(set(rows)) + [(9, "alone"), (8, "")], "doc_id long, bare string")
    expected = {(d, a, b) for d, a in rows for e, b in rows if d == e and SequenceMatcher(None, a, b).ratio() >= 0.6} | {(9, "alone", "alone"), (8, "", "")}
    for few in (32, 0):
        monkeypatch.setattr(similarity, "FEW_SPELLINGS", few)
        found = [tuple(r) for r in similarity.similar_spellings(spellings, 0.6).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    # a document with headers on one page only has nobody to ask
    asked, whole = [], similarity.similar_spellings
    monkeypatch.setattr(similarity, "similar_spellings", lambda s: asked.append(s) or whole(s))
    lines = [(1, i, f"1:{i}", 1, f"The annual header {i}", 0.9, [0.0, 0.1, 1.0, 0.2]) for i in range(3)] + [(2, p, f"2:{p}", p, "The annual header of 2", 0.9, [0.0, 0.1, 1.0, 0.2]) for p in (1, 2)]
    similarity.header_consensus(spark.createDataFrame(lines, LINE)).collect()
    assert {r["doc_id"] for r in asked[0].collect()} == {2}


def _counted(spark, df, column):
    """``df`` with a function that counts the rows that it is asked for, as often as they are."""
    seen = spark.sparkContext.accumulator(0)

    def same(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(same, df.schema[column].dataType).asNondeterministic()(column)), seen


def test_words_are_counted_once_for_joined_words(spark):
    words = spark.createDataFrame([("annual", 900), ("examination", 900)], "word string, n long")
    pairs = spark.createDataFrame([("annual", "examination", 50), ("other", "pair", 7)], "first string, second string, n long")
    tokens = spark.createDataFrame([("annualexamination",)], "token string")
    counted, seen = _counted(spark, words, "n")
    asked, met = _counted(spark, pairs, "n")
    out = reconcile.split_joined(tokens, counted, asked).collect()
    assert [(r["token"], r["suggested"], r["taken"]) for r in out] == [("annualexamination", "annual examination", True)]
    assert seen.value == 2 and met.value <= 2


def test_pairs_of_words_are_counted_once_for_lines(spark):
    lines = spark.createDataFrame([(1, 1, "the papcr here"), (1, 2, "papcr")], "doc_id long, line_id long, text string")
    spelling = spark.createDataFrame([("papcr", "paper")], "token string, corrected string")
    pairs, seen = _counted(spark, spark.createDataFrame([("the", "paper", 9), ("paper", "here", 9), ("no", "one", 3)], "first string, second string, n long"), "n")
    corrected, reviews = reconcile.correct_lines(lines, spelling, pairs)
    assert {(r["line_id"], r["text"], r["confidence"]) for r in corrected.collect()} == {(1, "the paper here", 0.95), (2, "paper", 0.9)}
    assert reviews.count() == 0 and seen.value <= 3


def test_plain_cells_are_taken_together(monkeypatch):
    seen = []

    class Tags:
        def search(self, html, begin=0):
            seen.append(begin)
            return reconcile_tags.search(html, begin)

        def finditer(self, html):
            for m in reconcile_tags.finditer(html):
                seen.append(m.start())
                yield m

    reconcile_tags = reconcile.TAGS
    monkeypatch.setattr(reconcile, "TAGS", Tags())
    row = "<tr>" + "\n".join(f"<td> w{i} &amp;  x</td>" for i in range(500)) + "</tr>"
    cells = reconcile.table_cells(f"<table>{row}<tr><td rowspan=2>a</td><th>b</th></tr><tr><td>c</td></tr><tr><td>d<tr><td>e</td></tr></table>", 10_000)
    assert cells == [(0, None, None, None, None, None, "malformed")]
    seen.clear()
    cells = reconcile.table_cells(f"<table>{row}<tr><td rowspan=2>a</td><th>b</th></tr><tr><td>c</td></tr></table>", 10_000)
    assert cells[499] == (0, 0, 499, 1, 1, "w499 & x", None) and [c[1:6] for c in cells[500:]] == [(1, 0, 2, 1, "a"), (1, 1, 1, 1, "b"), (2, 1, 1, 1, "c")]
    assert len(seen) < 30
    assert reconcile.table_cells(f"<table>{row}</table>", 499) == [(None, None, None, None, None, None, "too_many_cells")]

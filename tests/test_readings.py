"""Second readings: pairing by boxes, acceptance of lines and pages, hooks for readers."""

from paperloom.operators import readings
from paperloom.plans import readings as plans

LINE = "doc_id long, page_number int, seq int, line_id string, text string, confidence double, normalized_bbox array<double>"


def _line(seq, text, sure, top, left=0.1, right=0.9, page=1):
    return (1, page, seq, f"{page}:{seq}", text, sure, None if top is None else [left, top, right, top + 0.04])


def test_boxes_of_turned_pages(spark):
    rows = [(q, box) for q, box in enumerate(([200.0, 200.0, 400.0, 600.0], [200.0, 1600.0, 600.0, 1800.0], [1600.0, 2200.0, 1800.0, 2600.0], [2200.0, 200.0, 2600.0, 400.0]))] + [(0, None)]
    df = spark.createDataFrame([(q, b, 1000, 1400, 2.0) for q, b in rows], "turns int, bbox array<double>, width int, height int, scale double")
    assert [r["normalized_bbox"] for r in readings.in_page(df).orderBy("turns", "bbox").collect()] == [None] + [[0.1, 0.0714286, 0.2, 0.2142857]] * 4


def test_pieces_go_to_one_line_in_order(spark):
    lines = spark.createDataFrame([_line(0, "a", 0.5, 0.10), _line(1, "b", 0.5, 0.12), _line(2, "c", 0.5, None), _line(3, "d", 0.5, 0.5), _line(0, "other page", 0.5, 0.10, page=2)], LINE)
    # the piece at 0.115 lies in both lines' boxes and shares more with the second
    again = spark.createDataFrame([_line(7, " right ", 0.8, 0.10, 0.5), _line(3, "left", 0.6, 0.10, 0.1, 0.5), _line(9, "second", 0.9, 0.115), _line(10, "margin", 0.9, 0.5, 0.95, 1.0), _line(11, None, None, 0.5)], LINE)
    out = {r["line_id"]: (r["candidate"], round(r["candidate_confidence"], 4)) for r in readings.pair_readings(lines, again).collect()}
    assert out == {"1:0": ("left right", 0.7), "1:1": ("second", 0.9), "1:3": ("", 0.0)}


def test_lines_and_pages_judged(spark):
    # page 1: a better reading of the whole; page 2: one line is better, one is not alike, one was sure; page 3: was not read again
    one = [_line(0, "thequickbrownfoxjumps", 0.6, 0.1), _line(0, "hello wor1d", 0.7, 0.1, page=2), _line(1, "alpha", 0.7, 0.2, page=2), _line(2, "certain", 0.95, 0.3, page=2), _line(0, "alone", 0.5, 0.1, page=3)]
    two = [_line(5, "the quick brown", 0.9, 0.1), _line(6, "fox jumps", 0.9, 0.2), _line(0, "hello world", 0.8, 0.1, page=2), _line(1, "omicron", 0.1, 0.2, page=2), _line(2, "certainty", 1.0, 0.3, page=2), _line(0, "nowhere", 0.9, 0.1, page=4)]
    kept, pages = readings.keep_better(spark.createDataFrame(one, LINE), spark.createDataFrame(two, LINE))
    assert {r["page_number"]: r["accepted"] for r in pages.collect()} == {1: True, 2: False}
    assert sorted((r["page_number"], r["seq"], r["text"], r["retry_text"], r["retry_confidence"]) for r in kept.collect()) == [
        (1, 5, "the quick brown", None, None), (1, 6, "fox jumps", None, None),
        (2, 0, "hello wor1d", "hello world", 0.8), (2, 1, "alpha", None, None), (2, 2, "certain", None, None), (3, 0, "alone", None, None),
    ]


def test_empty_readings(spark):
    none, some = spark.createDataFrame([], LINE), spark.createDataFrame([_line(0, None, None, None), _line(1, "", 0.1, 0.2)], LINE)
    assert readings.keep_better(none, some)[0].count() == 0
    kept, pages = readings.keep_better(some, none)
    assert pages.count() == 0 and kept.count() == 2 and kept.filter("retry_text is not null").count() == 0


def test_hooks(spark):
    asked = []
    pages = spark.createDataFrame([("a", b"joinedwordshere\nfine"), ("b", b"good words\nfine"), ("c", b"")], "path string, content binary")

    def read(content):
        return [{"text": t, "confidence": 0.7 if "joined" in t else 0.95, "bbox": [0, i, 9, i + 1]} for i, t in enumerate(bytes(content).decode().split("\n")) if t]

    def region(content, boxes):
        assert asked == [] and [int(b[1]) for b in boxes] == [0]
        return [[{"text": "joined words", "confidence": 0.9}, {"text": " here", "confidence": 0.8}]]

    kept, verdicts = readings.read_twice(pages, read, None, region)
    assert {(r["path"], r["text"], r["retry_text"], r["retry_confidence"]) for r in kept.collect()} == {("a", "joinedwordshere", "joined words here", 0.85), ("a", "fine", None, None), ("b", "good words", None, None), ("b", "fine", None, None)}
    assert [(r["path"], r["reasons"], r["accepted"]) for r in verdicts.collect()] == [("a", ["low_confidence_density", "fused_word_density"], False)]
    better = lambda content: [{"text": t.replace("joinedwordshere", "joined words here"), "confidence": 0.99, "bbox": []} for t in bytes(content).decode().split("\n")]
    kept, verdicts = readings.read_twice(pages, read, better)
    assert {(r["path"], r["text"]) for r in kept.collect()} == {("a", "joined words here"), ("a", "fine"), ("b", "good words"), ("b", "fine")} and verdicts.first()["accepted"]
    # a reader of regions that answers for another number of them is not heard
    assert readings.read_twice(pages, read, None, lambda content, boxes: [])[0].filter("retry_text is not null").count() == 0


def test_both_choices_occur(spark):
    rows = plans.second_readings(spark, "/root/testdata/sf0.001").collect()
    assert {r["accepted"] for r in rows if r["read_again"]} == {True, False} and any(r["n_retried"] for r in rows)


def test_cursors(spark):
    import base64
    from datetime import datetime

    import pytest

    from paperloom.operators import jobs

    at = datetime(2024, 1, 2, 3, 4, 5, 6)
    assert jobs.decode_cursor(jobs.encode_cursor(at, "a/ü+")) == (at, "a/ü+") and set("+/=") & set(jobs.encode_cursor(at, "??>>")) == set()
    for bad in ("", "!", "e30", "a" * 5, base64.urlsafe_b64encode(b'["x", 1]').decode(), base64.urlsafe_b64encode(b'["2024-01-02", null]').decode()):
        with pytest.raises(ValueError, match="not a cursor"):
            jobs.decode_cursor(bad)
    rows = spark.createDataFrame([(i, None if i == 9 else datetime(2024, 1, 1 + i // 3)) for i in range(10)], "id int, updated_at timestamp")
    seen, cursor, pages = [], None, 0
    while True:
        page, cursor = jobs.cursor_page(rows, 4, cursor)
        seen, pages = seen + [r["id"] for r in page], pages + 1
        if cursor is None:
            break
    assert seen == [8, 7, 6, 5, 4, 3, 2, 1, 0] and pages == 3
    assert jobs.cursor_page(rows.filter("false"), 4) == ([], None)


def test_payloads_are_parsed_once(spark):
    from pyspark.sql import functions as F

    from paperloom.operators import governance

    texts = ['{"language": "en", "quality_score": 0.9, "warning_count": "2"}', '{"language": "en", "quality_score": "x", "warning_count": 2}', '{"language": "de", "quality_score": 0.9, "warning_count": 2}', '{"language": "en"', None, "{}", '{"language": "en", "quality_score": 0.9, "warning_count": 7}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    found = governance.search_lexical(rows, language="en", quality_min=0.5, warning_max=6)
    assert [r["id"] for r in found.collect()] == [0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
    variants = rows.withColumn("payload", F.try_parse_json("payload"))
    assert [r["id"] for r in governance.search_lexical(variants, language="en", quality_min=0.5, warning_max=6).collect()] == [0]


def test_lines_of_few_pages_are_in_memory_together(spark):
    """A batch of many pages goes on in pieces: the first lines are out before the last page is read."""
    import pyarrow as pa

    from paperloom.operators import enrich

    batch = pa.RecordBatch.from_pylist([{"path": str(i), "content": b"x"} for i in range(1000)])
    sizes = [len(few) for few in enrich.few_pages(iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= enrich.PAGES_TOGETHER
    pages = spark.createDataFrame([(str(i), b"x") for i in range(300)], "path string, content binary").coalesce(1)
    lines = enrich.ocr_pages(pages, lambda c: [{"text": "a", "confidence": 1}, {"text": "b", "bbox": [1, 2, 3, 4]}]).collect()
    assert len(lines) == 600 and {(r["seq"], r["text"], r["confidence"], tuple(r["bbox"])) for r in lines} == {(0, "a", 1.0, ()), (1, "b", 0.0, (1.0, 2.0, 3.0, 4.0))}

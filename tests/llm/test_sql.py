"""What SQL can say of the queries that it cannot say whole: the same numbers from DuckDB on the test tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import oracle

from paperloom.llm import queries

SF = "/root/testdata/sf0.001"

PARTS = {
    "op2_source_mixing": (["doc_id", "size", "source_size"], r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)
        SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM d"""),
    "op5_secret_scan": (["doc_id", "n_assign", "n_access", "n_hex"], r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
        len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents"""),
    "op8_fingerprints": (["doc_id", "n_chars", "edited_sha256"], """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER (ORDER BY doc_id), (SELECT arg_min(text, doc_id) FROM documents), '') AS f FROM documents)
        SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(f, 1, length(t) // 2)) AS edited_sha256 FROM d"""),
    "op10_neighbours": (["query_id", "rank", "vec_id", "score"], """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM p QUALIFY rank <= 20"""),
}


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", [n for n in PARTS if n != "op10_neighbours"])
def test_part_equals_sql(spark, con, name):
    columns, sql = PARTS[name]
    found = queries.queries()[name](spark, SF).select(*columns).collect()
    assert oracle.rows_of(columns, found) == oracle.rows_of(columns, con.sql(sql).fetchall())


def test_every_document_has_a_language(spark, con):
    from zlib import crc32

    found = {r["doc_id"]: r["held_out"] for r in queries.op1_language_id(spark, SF).collect()}
    assert found == {d: crc32(str(d).encode()) % 5 == 0 for (d,) in con.sql("SELECT doc_id FROM documents").fetchall()}


def test_neighbours_recall_on_the_test_tables(spark, con):
    columns, sql = PARTS["op10_neighbours"]
    near = {(q, v) for q, _, v, _ in con.sql(sql).fetchall()}
    rows = queries.op10_neighbours(spark, SF).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in rows} & near) / len(near) >= 0.9
    assert {r["query_id"] for r in rows} == {q for q, _ in near} and all(sum(r["query_id"] == q for r in rows) == 20 for q in {q for q, _ in near})

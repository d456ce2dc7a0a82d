"""The corpus pipeline against a plain version of its stages."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
from paperloom.llm import langid, mixing, secrets
from paperloom.llm._common import table
from paperloom.llm.queries import vocabulary


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = langid.fit(docs)
    plain = [r for r in docs.collect()]
    rejected = dict(zip([r["doc_id"] for r in plain], model.predict([r["text"] or "" for r in plain])[2], strict=True))
    kept = [r for r in plain if not rejected[r["doc_id"]]]
    stages = dict(corpus_pipeline.STAGES)
    now = stages["language ID"](spark, docs, sf)
    assert now.columns == docs.columns and Counter(r["doc_id"] for r in now.collect()) == Counter(r["doc_id"] for r in kept)
    now = stages["SimHash near-dedup"](spark, now, sf)
    first = {c for _, _, c in brute.components([(r["doc_id"], r["text"]) for r in kept])}
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == first
    now = stages["secret scans"](spark, now, sf)
    expected = {r["doc_id"]: secrets.redact(r["text"]) for r in kept if r["doc_id"] in first}
    assert now.columns == docs.columns and {r["doc_id"]: r["text"] for r in now.collect()} == expected
    mixed = stages["mixing to target weights"](spark, now, sf)
    plan = {r["doc_id"]: r for r in mixing.mix(now).collect()}
    times = {d: int(r["taken"] / r["size"] + 0.5) if r["size"] else 1 for d, r in plan.items()}
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in times.items() if n})
    packed = corpus_pipeline.run(spark, sf).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    tokens = sum((len(whole.encode(expected[d], add_special_tokens=False).ids) + 1) * n for d, n in times.items())
    assert sum(r["length"] for r in packed) == tokens
    assert len({r["sequence_id"] for r in packed}) <= -(-tokens // 2048) + 2


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, clashing columns and no rows at all: no stage fails, columns stay, and nothing clean goes but copies."""
    from test_operators import SCHEMA, rows

    for some in (rows(), []):
        docs = spark.createDataFrame(some, SCHEMA).repartition(3)
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, now = now, corpus_pipeline.staged(stage(spark, now, ""))
            assert now.columns == docs.columns, name
            if name != "mixing to target weights":
                assert {r["doc_id"] for r in now.collect()} <= {r["doc_id"] for r in before.collect()}
        packed = dict(corpus_pipeline.STAGES)["best-fit packing"](spark, now, "").collect()
        assert (len(packed) > 0) == bool(some) and all(r["offset"] + r["length"] <= 2048 for r in packed)

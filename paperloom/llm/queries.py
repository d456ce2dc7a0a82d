"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import disclosure, langid, licenses, mixing, neighbours, packing, quality, ranking, secrets, simhash, sketches, sql, substrings, tries
from paperloom.llm._common import is_held_out, table


def vocabulary() -> str:
    """The vocabulary file that packing uses unless another is named."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.filter(kinds, lambda k: k == F.lit(kind)))).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS]
    base = F.filter("found", lambda s: s["kind"] != "literal")
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.classify(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.fingerprint(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(table(spark, sf_dir, "conversations"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in disclosure.PATTERNS]
    base = F.filter("found", lambda s: s["kind"] != "term")
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_source_mixing, op3_substring_dedup, op4_simhash, op5_secret_scan, op6_license_scan, op7_quality, op8_fingerprints, op9_best_fit_packing, op10_neighbours, op11_conversation_trie, op12_personal_data, op13_ranked_search)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": sql.substring_dedup(), "op6_license_scan": sql.license_scan(), "op11_conversation_trie": sql.conversation_trie(), "op12_personal_data": sql.personal_data(), "op13_ranked_search": sql.ranked_search()}

"""A training corpus from ``documents``: five stages, each on what its predecessor kept.

Documents whose language is rejected go; one document of each near-duplicate
group stays; secrets are replaced; sources are mixed to target weights; what is
left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import langid, mixing, packing, secrets, simhash
from paperloom.llm._common import staged, table
from paperloom.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learned from ``docs``, does not reject. Null and empty texts, and texts without letters, go; repeated rows stay or go together; an empty table stays empty."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id's. Null and empty texts are copies of one another; of repeated rows one stays; rows without an id stay where nothing of their group has one; an empty table stays empty."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced in their whole texts and n_chars counted again. Nulls stay null, repeated rows stay, an empty table stays empty."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by blocks of words. Null and empty texts, without words to take, stay once; repeated rows count each; a null source is a source; an empty table stays empty."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. A null text is empty: one end mark; very long texts are cut into pieces; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL can express neither the trained model nor the token ids: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

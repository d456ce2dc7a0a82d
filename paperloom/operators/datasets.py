"""Human-verified datasets: admission, label states, releases with leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.keys import split_of


def admit_items(items: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted items, and quarantined ones with the reason: student data that is not de-identified, or a project that is not open."""
    met = items.join(projects.select("project_id", F.col("status").alias("project_status")), "project_id", "left")
    reason = F.when(F.coalesce("contains_student_data", F.lit(True)) & ~F.coalesce("deidentified", F.lit(False)), "not_deidentified").when(~F.coalesce(F.col("project_status").isin("draft", "active"), F.lit(False)), "project_closed")
    marked = met.withColumn("reason", reason).drop("project_status")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def label_state(reviews: DataFrame) -> DataFrame:
    """item_id, verified, rejected and state: one review a reviewer (the first), gold from two verifications, silver from one, rejected from a rejection alone, else unlabelled."""
    first = reviews.groupBy("item_id", "reviewer").agg(F.min_by("decision", "seq").alias("decision"))
    per = first.groupBy("item_id").agg(F.count_if(F.col("decision") == "verified").alias("verified"), F.count_if(F.col("decision") == "rejected").alias("rejected"))
    return per.withColumn("state", F.when(F.col("verified") >= 2, "gold").when(F.col("verified") == 1, "silver").when(F.col("rejected") > 0, "rejected").otherwise("unlabelled"))


def dataset_release(items: DataFrame) -> DataFrame:
    """item_id, source_document_id, content_sha256 and split of the gold items; a document's items lie in one split."""
    return items.filter("state = 'gold'").select("item_id", "source_document_id", "content_sha256", split_of("source_document_id").alias("split"))


def release_manifest(items: DataFrame) -> DataFrame:
    """One row: item_count, not_gold, releasable, the counts of the splits and the manifest's hash over the sorted items' hashes.

    A tree of hashes keeps the list of items out of any one row: each level joins
    the hashes that agree in three digits less than the level below, so that a
    row holds about 4096 of them, and the tree is as deep as the count asks.
    """
    entry = F.sha2(F.concat_ws("\0", F.col("item_id").cast("string"), "content_sha256", split_of("source_document_id")), 256)
    each = items.select("state", entry.alias("entry"), split_of("source_document_id").alias("split"))
    depth = 3
    while items.count() >> 4 * (depth + 3):
        depth += 3
    names = [f"n_{s}" for s in ("train", "validation", "test")]
    level = each.select("entry", F.col("entry").alias("h"), F.lit(1).cast("long").alias("n"), (F.col("state") != "gold").cast("long").alias("bad"), *[(F.col("split") == n[2:]).cast("long").alias(n) for n in names])
    for digits in range(depth, -1, -3):
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", "h"))), lambda s: s["h"]), "\n"), 256)
        level = level.withColumn("g", F.substring("entry", 1, digits)).groupBy("g").agg(joined.alias("h"), *[F.sum(c).alias(c) for c in ("n", "bad", *names)]).withColumnRenamed("g", "entry")
    whole = level.agg(F.max("h").alias("manifest_sha256"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "bad", *names)])
    one = whole.select(F.col("n").alias("item_count"), F.col("bad").alias("not_gold"), *names, "manifest_sha256")
    return one.withColumn("releasable", (F.col("item_count") > 0) & (F.col("not_gold") == 0))

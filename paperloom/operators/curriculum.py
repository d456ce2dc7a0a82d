"""Curricula and taxonomies: validation, references, trees, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.staging import staged


def validate_objectives(objectives: DataFrame) -> DataFrame:
    """row and rule of imported objectives (row, stable_code, title, description, parent_code, prerequisites, replaces): required_field, duplicate_code (the later one), unknown references."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    whole = filled("stable_code") & filled("title") & filled("description")
    code = F.lower(F.trim("stable_code"))
    again = F.row_number().over(Window.partitionBy(code).orderBy("row")) > 1
    good = objectives.filter(whole).withColumn("again", again)
    missing = objectives.filter(~F.coalesce(whole, F.lit(False))).select("row", F.lit("required_field").alias("rule"))
    kept = good.filter("not again")
    return missing.union(good.filter("again").select("row", F.lit("duplicate_code"))).union(check_references(kept).select("row", F.concat(F.lit("unknown_"), "kind")))


def check_references(objectives: DataFrame) -> DataFrame:
    """row, kind (parent, prerequisite, replacement) and reference of codes that no objective has."""
    one = lambda c: F.array_compact(F.array(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))))
    refs = None
    for kind, codes in (("parent", one("parent_code")), ("prerequisite", F.coalesce("prerequisites", F.array().cast("array<string>"))), ("replacement", F.coalesce("replaces", F.array().cast("array<string>")))):
        part = objectives.select("row", F.lit(kind).alias("kind"), F.explode(codes).alias("reference"))
        refs = part if refs is None else refs.union(part)
    known = objectives.select(F.trim("stable_code").alias("reference")).distinct()
    return refs.join(known, "reference", "left_anti").select("row", "kind", "reference")


def tree_check(nodes: DataFrame) -> DataFrame:
    """node_id and rule of a tree's (node_id, parent_id) faults: duplicate, unknown_parent, cycle (parents lead back to a node on the way).

    Every round a node's pointer jumps as far again, so a tree of any depth takes
    as many rounds as its depth has bits; what no round brings to an end runs
    into a cycle. A null node_id is left out.
    """
    flat = nodes.filter("node_id is not null").select("node_id", "parent_id").distinct()
    twice = nodes.filter("node_id is not null").groupBy("node_id").count().filter("count > 1").select("node_id", F.lit("duplicate").alias("rule"))
    known = flat.select(F.col("node_id").alias("parent_id")).distinct()
    lost = flat.filter("parent_id is not null").join(known, "parent_id", "left_anti").select("node_id", F.lit("unknown_parent").alias("rule")).distinct()
    # a pointer that leaves the tree, at a root or an unknown parent, has come to its end
    at = staged(flat.join(known, "parent_id", "left_semi").groupBy("node_id").agg(F.min("parent_id").alias("jump")))
    left = at.count()
    while left:
        on = staged(at.join(at.select(F.col("node_id").alias("jump"), F.col("jump").alias("next")), "jump").select("node_id", F.col("next").alias("jump")))
        now = on.count()
        at = on
        if now == left:
            break
        left = now
    return twice.union(lost).union(at.select("node_id", F.lit("cycle").alias("rule")))


def objective_coverage(objectives: DataFrame, mappings: DataFrame, approved_only: bool = False) -> DataFrame:
    """objective_id, mapping_count and mapped; drafts count unless only approved ones are asked for."""
    counted = mappings.filter("status = 'approved'") if approved_only else mappings
    per = counted.groupBy("objective_id").agg(F.count("*").alias("mapping_count"))
    out = objectives.select("objective_id").join(per, "objective_id", "left").withColumn("mapping_count", F.coalesce("mapping_count", F.lit(0)))
    return out.withColumn("mapped", F.col("mapping_count") > 0)


def coverage_totals(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.count("*").alias("objectives"), F.count_if("mapped").alias("mapped"), F.count_if(~F.col("mapped")).alias("unmapped"))


def validate_rubrics(rubrics: DataFrame) -> DataFrame:
    """rubric_id and rule of rubrics (criteria: an array of id and weight): missing and repeated ids, negative weights, a total that is neither 0 nor 100."""
    c = rubrics.select("rubric_id", F.explode_outer("criteria").alias("c")).select("rubric_id", "c.*")
    per = c.groupBy("rubric_id").agg(
        F.count_if(F.trim(F.coalesce("id", F.lit(""))) == "").alias("blank"), (F.count("id") - F.countDistinct("id")).alias("twice"), F.count_if(F.col("weight") < 0).alias("negative"), F.sum("weight").alias("total")
    )
    rules = F.array_compact(F.array(F.when(F.col("blank") > 0, "missing_id"), F.when(F.col("twice") > 0, "duplicate_id"), F.when(F.col("negative") > 0, "negative_weight"), F.when((F.abs("total") > 0.01) & (F.abs(F.col("total") - 100) > 0.01), "total")))
    return per.select("rubric_id", F.explode(rules).alias("rule"))


def check_pack_items(packs: DataFrame, bank: DataFrame) -> DataFrame:
    """pack_id, item_id and reason of packs' items that the bank lacks, that are stale or not approved."""
    items = packs.select("pack_id", F.explode("item_ids").alias("item_id"))
    met = items.join(bank.select("item_id", "status", "stale"), "item_id", "left")
    reason = F.when(F.col("status").isNull(), "missing").when(F.coalesce("stale", F.lit(False)), "stale").when(F.col("status") != "approved", "not_approved")
    return met.withColumn("reason", reason).filter("reason is not null").select("pack_id", "item_id", "reason")

"""Deterministic evidence views over the given tables: lines, questions, overlays, elements, cells, jobs, resources, audit and sync events.

Each view is written in DataFrame operations here and in SQL in ``sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.overlays import effective_value
from paperloom.operators.segment import segment_questions


#: The type of a model's record of a question.
AI = "struct<source_line_ids:array<string>,source_page:int,question_id:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("seq", "part"))
    numbered = F.concat((F.floor(F.col("seq") / 3) + 1).cast("string"), F.lit(". "), "part", F.lit(" ("), ((F.col("doc_id") + F.col("seq")) % 10 + 1).cast("string"), F.lit(" marks)"))
    y = (F.col("seq") % 40) / 40.0
    return parts.select(
        "doc_id", "source", "seq", (F.floor(F.col("seq") / 40) + 1).cast("int").alias("page_number"), F.concat_ws(":", "doc_id", "seq").alias("line_id"),
        F.when(F.col("seq") % 3 == 0, numbered).otherwise(F.col("part")).alias("text"),
        (((F.col("doc_id") * 31 + F.col("seq") * 17) % 41 + 60) / 100.0).alias("confidence"), F.array(F.lit(0.1), y, F.lit(0.9), y + 0.02).alias("normalized_bbox"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment_questions(lines(spark, sf_dir)).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    key = F.col("doc_id") + F.col("group_no")
    ai = F.create_map(F.lit("topic"), F.col("source"))
    teacher = F.when(key % 7 == 0, F.create_map(F.lit("topic"), F.concat(F.lit("teacher-"), "source"))).otherwise(F.create_map().cast("map<string,string>"))
    out = found.withColumn("ai", ai).withColumn("teacher_override", teacher)
    level = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("group_no") % 3 + 1).cast("int"))
    return out.withColumn("topic", effective_value("topic")).withColumn("difficulty", level)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = lines(spark, sf_dir).filter((F.col("doc_id") + F.col("seq")) % 11 == 0)
    status = F.element_at(F.array(*map(F.lit, ("draft", "reviewed", "approved", "rejected", "reverted"))), ((F.col("doc_id") * 7 + F.col("seq")) % 5 + 1).cast("int"))
    stale = F.col("doc_id") % 4 == 0
    return chosen.select(
        "doc_id", F.concat(F.lit("c-"), "line_id").alias("correction_id"), F.lit("line").alias("target_kind"), F.col("line_id").alias("target_id"), F.concat(F.lit("corrected: "), "text").alias("replacement"),
        F.lit("reading slip").alias("reason"), status.alias("status"), F.lit(1).alias("version"), F.when(stale, F.sha2(F.lit("before"), 256)).otherwise(F.lit(None)).alias("old_hash"),
    ).join(evidence(spark, sf_dir), "doc_id").withColumn("source_hash", F.coalesce("old_hash", "content_hash")).drop("old_hash", "content_hash")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def question_corrections(questions_: DataFrame) -> DataFrame:
    key = F.col("doc_id") + F.col("group_no")
    base = questions_.select("doc_id", "group_no", F.col("question_id").alias("target_id"), "display_number", key.alias("key"))
    text = base.filter(key % 5 == 0).select("doc_id", "target_id", F.lit("question").alias("target_kind"), F.concat(F.lit("Question "), "display_number").alias("replacement"), "group_no")
    marks = base.filter(key % 3 == 0).select("doc_id", "target_id", F.lit("marks").alias("target_kind"), (F.col("key") % 120).cast("string").alias("replacement"), "group_no")
    both = text.union(marks)
    return both.select("doc_id", "target_id", "target_kind", "replacement", F.concat_ws("-", "target_kind", "doc_id", "group_no").alias("correction_id"), F.lit(1).alias("version"), F.lit("approved").alias("status"), F.lit(False).alias("stale"))


def mappings(questions_: DataFrame) -> DataFrame:
    approved = (F.col("doc_id") + F.col("group_no")) % 2 == 0
    return questions_.select("doc_id", "question_id", F.when(approved, "approved").otherwise("draft").alias("status"), F.when(approved, "teacher").otherwise("model").alias("method"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On each page a figure over lines 6 to 8 and a formula over line 10."""
    pages = lines(spark, sf_dir).select("doc_id", "page_number").distinct()
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.array(*map(F.lit, b)).alias("normalized_bbox")) for k, b in (("figure", (0.1, 0.15, 0.9, 0.22)), ("formula", (0.1, 0.25, 0.9, 0.27)))])).alias("e")
    return pages.select("doc_id", "page_number", kinds).select("doc_id", "page_number", F.concat_ws("-", "doc_id", "page_number", "e.type").alias("element_id"), "e.*")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On each page a grid of two rows and three columns over lines 12 to 17."""
    pages = lines(spark, sf_dir).select("doc_id", "page_number").distinct()
    spots = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("cell_index")
    each = pages.select("doc_id", "page_number", F.col("page_number").alias("table_index"), spots).withColumn("row", F.floor(F.col("cell_index") / 3).cast("int")).withColumn("col", (F.col("cell_index") % 3).cast("int"))
    x = lambda i: F.element_at(F.array(F.lit(0.1), F.lit(0.35), F.lit(0.65), F.lit(0.9)), F.col("col") + 1 + i)
    y = lambda i: F.element_at(F.array(F.lit(0.3), F.lit(0.375), F.lit(0.45)), F.col("row") + 1 + i)
    text = F.when((F.col("doc_id") + F.col("cell_index")) % 4 == 0, F.lit("")).otherwise(F.concat_ws(" ", F.lit("cell"), F.col("cell_index").cast("string")))
    return each.withColumn("row_span", F.lit(1)).withColumn("col_span", F.when((F.col("doc_id") % 9 == 0) & (F.col("cell_index") == 0), 2).otherwise(1)).withColumn("text", text).withColumn("normalized_bbox", F.array(x(0), y(0), x(1), y(1))).withColumn("geometry_normalized", F.col("doc_id") % 2 == 0)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    work = F.element_at(F.array(*map(F.lit, ("text_recognition", "document_parsing", "table_recognition", "formula_recognition"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    day = F.col("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("Paper_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("input_name"), work.alias("workflow"), status.alias("status"), day.alias("created_at"),
        day.alias("started_at"), F.when(status == "completed", day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 100).cast("decimal(18,6)"))).alias("completed_at"), day.alias("updated_at"),
        (F.col("o_totalprice") / 500000).alias("quality_score"), (F.col("o_orderkey") % 5).alias("warning_count"), (F.col("o_orderkey") % 17 == 0).alias("pinned"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    kind = F.element_at(F.array(*map(F.lit, ("worker_job", "answer_script", "dataset_item", "student_progress"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "completed").otherwise("archived")
    key = F.concat(F.col("n_name"), F.lit("/"), F.col("o_orderkey").cast("string"))
    payload = F.concat(F.lit('{"legal_hold": '), F.when(F.col("o_orderkey") % 6 == 0, "true").otherwise("false"), F.lit(', "quality_score": 0.'), (F.col("o_orderkey") % 100).cast("string"), F.lit(', "object_key": "'), key, F.lit('"}'))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("resource_id"), kind.alias("resource_type"), status.alias("status"), F.col("n_name").alias("tenant_id"), F.col("c_mktsegment").alias("course_id"), F.lit(None).cast("string").alias("unit_id"),
        F.col("c_name").alias("created_by"), F.when(F.col("o_orderkey") % 5 == 0, "private").otherwise("tenant").alias("visibility"), F.col("o_orderdate").alias("updated_at"), payload.alias("payload"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    h = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("string")), 256)
    rows = e.select((F.col("user_id") % 10).alias("tenant"), F.col("event_id").alias("sequence"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"), h.alias("event_hash"))
    from pyspark.sql import Window

    before = F.lag("event_hash").over(Window.partitionBy("tenant").orderBy("sequence"))
    return rows.withColumn("previous_hash", F.when(F.col("sequence") % 501 == 500, F.lit("broken")).otherwise(before))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.lit("t").alias("tenant"), F.lit("sync").alias("endpoint"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type", k).alias("key"), F.sha2(F.floor(F.col("value")).cast("string"), 256).alias("request_hash"), "ts", "event_id")

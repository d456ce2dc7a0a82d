"""Mixing sources to target weights by Sainte-Laguë apportionment.

Documents are dealt by a seeded hash to shards of about equal words, so that a
large source has many. A shard's words in seeded order form equal-token blocks.
All blocks of the mix are apportioned to the shards by highest quotients
target / (2 k + 1): the divisor at which the rounded shares add up to the
blocks is found by narrowing it between probes, each counted in one
aggregation over the shards. A shard takes its whole line as often as its quota
holds it and then the blocks at the start of its seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._common import own, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, about so many words of a shard, and how often a document is taken at most.
BLOCK = 64
SHARD = 1 << 16
REPEATS = 3
WEIGHTS = (1, 2, 3)
PROBES = 48


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` (distinct in ``order``) numbered from 0 in that order: a range-partitioned sort, and an offset for each of its partitions."""
    part = own("part", rows)
    dealt = staged(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))  # a row for each partition
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(rank, inside).join(F.broadcast(before), part).withColumn(rank, F.col(rank) - 1 + F.col("before")).drop(part, "before")


def probed(rows: DataFrame, probes: list[float], value) -> list:
    """The sum of ``value``, a function of a probe's column, over ``rows`` at each probe: one aggregation that is compiled once for all probes."""
    each = rows.withColumn("probe", F.explode(F.array(*map(F.lit, probes))))
    found = {r["probe"]: r["total"] for r in each.groupBy("probe").agg(F.sum(value(F.col("probe"))).alias("total")).collect()}
    return [found.get(p) or 0 for p in probes]


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size and target of each source: all words shared by weight, none above ``repeats`` times its own.

    Weights repeat over the sources in code-point order, a null source last.
    """
    marked = ranked(sources.withColumn("last", F.col("source").isNull()), [F.col("last"), F.col("source")], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = staged(marked.select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * repeats).cast("double").alias("most")))
    total, most = rows.agg(F.sum("source_size"), F.max(F.col("most") / F.col("w"))).first()
    level = 0.0
    low, high = 0.0, float(most or 0.0)
    while total and high > 0 and low < high * 0.999:  # a level at which no more than the total is given out, near the last such
        step = (high - low) / (PROBES + 1)
        probes = [low + step * (i + 1) for i in range(PROBES)]
        given = probed(rows, probes, lambda p: F.least(F.col("most"), F.col("w") * p))
        low = max([low, *(p for p, g in zip(probes, given, strict=True) if g <= total * (1 - 1e-9))])
        high = min([high, *(p for p, g in zip(probes, given, strict=True) if g > total * (1 - 1e-9))])
    level = low
    while True:  # what lies above its bound is reshared by weight until none does
        above = F.col("w") * F.lit(level) >= F.col("most")
        total, fixed, open_w = rows.agg(F.sum("source_size"), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("w")))).first()
        if not total or not open_w:
            break
        new = (total - (fixed or 0.0)) / open_w
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("most"), F.col("w") * F.lit(level)).alias("target"))


def apportioned(cells: DataFrame, seats: int, order: list[str]) -> DataFrame:
    """``cells`` with ``quota``: ``seats`` given to the highest quotients ``votes`` / (2 k + 1); ties go by ``order``."""
    rounded = lambda d: F.floor(F.col("votes") / d + 0.5)
    votes, n, most = cells.agg(F.sum("votes"), F.count("*"), F.max("votes")).first()
    if not votes or seats <= 0:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    low, high = votes / (seats + n + 1.0), 2.0 * most + 1.0  # at low the shares hold the seats or more, at high none
    while high - low > 1e-13 * high:
        step = (high - low) / (PROBES + 1) if high < 4 * low else (high / low) ** (1 / (PROBES + 1))
        probes = [low + step * (i + 1) if high < 4 * low else low * step ** (i + 1) for i in range(PROBES)]
        probes = sorted({p for p in probes if low < p < high})
        if not probes:
            break
        counts = probed(cells, probes, rounded)
        low = max([low, *(p for p, c in zip(probes, counts, strict=True) if c >= seats)])
        high = min([high, *(p for p, c in zip(probes, counts, strict=True) if c < seats)])
        if low in probes and counts[probes.index(low)] == seats:
            return cells.withColumn("quota", rounded(F.lit(low)).cast("long"))
    given = cells.withColumn("quota", rounded(F.lit(high)).cast("long"))
    left = seats - (given.agg(F.sum("quota")).first()[0] or 0)
    # what is left goes to the next quotients, which lie within rounding of one another
    tied = given.select(*order, (F.col("votes") / (2 * F.col("quota") + 1)).alias("next")).orderBy(F.desc("next"), *order).limit(left).select(*[F.col(c).alias(f"t_{c}") for c in order], F.lit(1).alias("extra"))
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return given.join(tied, same, "left").withColumn("quota", F.col("quota") + F.coalesce("extra", F.lit(0))).drop("extra", *[f"t_{c}" for c in order])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """doc_id, text_hash, size, source_size, target (its source's) and taken words of every row of ``docs`` (doc_id, text, source).

    A null or empty text has size 0 and nothing is taken of it; a null source is
    a source of its own; equal rows count and are taken each by itself; other
    columns are ignored; an empty table gives no rows. The same rows and seed
    give the same result, however they are partitioned.
    """
    sized = staged(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), n_words().alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = staged(targets(sources, weights, repeats))
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long"))
    aim = aims.withColumnRenamed("source", "aim_source")
    dealt = sized.join(aim, F.col("source").eqNullSafe(F.col("aim_source"))).drop("aim_source").withColumn("shard", spread)
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    cells = staged(cells.withColumn("votes", F.col("target") * F.col("cell_size") / F.greatest(F.col("source_size"), F.lit(1))))
    total = cells.agg(F.sum("cell_size")).first()[0] or 0
    quotas = apportioned(cells, round(total / block), ["source", "shard"])
    words = F.least(F.col("quota") * block, F.col("cell_size") * repeats)
    quotas = quotas.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "cell_size", words.alias("words"))
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), "doc_id", "text_hash", "size")
    placed = dealt.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = placed.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    over = F.col("words") % F.greatest(F.col("cell_size"), F.lit(1))
    rounds = F.floor(F.col("words") / F.greatest(F.col("cell_size"), F.lit(1)))
    part = F.greatest(F.lit(0), F.least(F.col("end"), over) - (F.col("end") - F.col("size")))
    return out.select("doc_id", "text_hash", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, all columns kept: each as often as the words taken of it hold its size, rounded; one without words stays once."""
    plan = staged(mix(docs, **options))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    count, key, mark, at = own("count", docs), own("key", docs), own("mark", docs), own("at", docs)
    # equal rows lie side by side in their shard's order: how often each is repeated
    each = plan.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)).agg(F.sum(times).alias(count), F.count("*").alias(at))
    same = Window.partitionBy("doc_id", mark).orderBy(mark)
    joined = docs.join(each, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(mark)))
    if plan.select("doc_id", "text_hash").groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        share = F.col(count)
    else:
        place = F.row_number().over(same) - 1
        share = F.floor((place + 1) * F.col(count) / F.col(at)) - F.floor(place * F.col(count) / F.col(at))
    return joined.withColumn(count, share.cast("int")).filter(F.col(count) > 0).withColumn(at, F.explode(F.sequence(F.lit(1), F.col(count)))).select(*docs.columns)

"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes least distance: with one coordinate more, every
vector gets the norm of the longest, and queries a zero there. Each of several
tables keys a vector by the slots into which Gaussian projections fall. A query
visits, besides its own bucket, perturbed ones in the order of their estimated
success: the chance that a neighbour at the usual distance falls into those
slots. How many it visits is measured on a bounded sample, so that the recall
aimed at is reached. Buckets meet the queries that visit them in blocks; what
the tables find is merged and ranked by exact inner products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._common import staged

TABLES = 2
#: Slot width, in standard deviations of a projection; offsets looked at on either side; buckets that a query visits at most.
WIDTH = 1.2
REACH = 3
VISITS = 512
#: Vectors of a bucket that one block holds; larger buckets are split.
BLOCK = 4096
#: Vectors, and queries among them, on which recall is measured, and the recall aimed at.
SAMPLE = 4096
SAMPLE_QUERIES = 256
AIM = 0.96


@dataclass
class Hashes:
    """directions (table, projection, coordinate), offsets (table, projection), slot width, usual distance of a neighbour, visits and the longest norm."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    distance: float
    visits: int
    longest: float

    def places(self, vectors: np.ndarray, table: int, query: bool) -> np.ndarray:
        """Places of the vectors along the projections, in slots."""
        if query:  # scaled to the longest norm, which does not change the order of its neighbours
            norm = np.linalg.norm(vectors, axis=1)
            full = np.column_stack((vectors * (self.longest / np.maximum(norm, 1e-300))[:, None], np.zeros(len(vectors))))
        else:
            full = np.column_stack((vectors, np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))))
        return (full @ self.directions[table].T + self.offsets[table]) / self.width

    def key(self, slots: np.ndarray) -> np.ndarray:
        """One number for the slots of each row."""
        out = np.zeros(slots.shape[:-1], np.uint64)
        for i in range(slots.shape[-1]):
            out = (out ^ slots[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def probes(self, place: np.ndarray, most: int) -> np.ndarray:
        """Keys of the buckets that a query at ``place`` visits, likeliest first."""
        slots, cost = np.zeros((1, 0)), np.zeros(1)
        spread = self.distance / self.width
        for x in place:
            own = math.floor(x) + np.arange(-REACH, REACH + 1)
            edges = np.array([math.erf((e - x) / spread / math.sqrt(2)) for e in (*own, own[-1] + 1)])
            chance = -np.log(np.maximum(np.diff(edges) / 2, 1e-12))
            total = (cost[:, None] + chance).ravel()
            keep = np.argsort(total, kind="stable")[:most]
            slots = np.column_stack((slots[keep // len(own)], own[keep % len(own)]))
            cost = total[keep]
        return self.key(slots)


def fit(sample: np.ndarray, n: int, longest: float, k: int, tables: int = TABLES, aim: float = AIM, seed: int = 11) -> Hashes:
    """Hash functions for ``n`` vectors of which ``sample`` is one.

    Where ``VISITS`` visits do not reach the recall aimed at, there are fewer
    projections, hence larger buckets; at none every query meets all vectors. A
    sample that is the whole table has to find all.
    """
    per_slot = 4.0  # populated slots of a projection, about
    count = max(2, round(math.log(max(n, 2048) / 2048) / math.log(per_slot)))
    if len(sample) < 2:
        count = 0
    if len(sample) == n:
        aim = 1.0
    while (out := _fitted(sample, n, longest, k, tables, aim, seed, count)) is None:
        count -= 1
    return out


def _fitted(sample: np.ndarray, n: int, longest: float, k: int, tables: int, aim: float, seed: int, count: int) -> Hashes | None:
    """Hash functions of ``count`` projections; none if the sample misses the aim within ``VISITS`` visits."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] + 1
    spread = longest or 1.0  # a projection of a vector has its norm as standard deviation over directions
    out = Hashes(rng.normal(size=(tables, count, dim)), np.zeros((tables, count)), spread / math.sqrt(max(dim, 1)) * WIDTH * math.sqrt(dim), 1.0, 1, longest)
    if not count:
        return out
    placed = np.column_stack((sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(axis=1), 0))))
    along = np.stack([placed @ d.T for d in out.directions])
    out.width = float(along.std(axis=1).mean()) * WIDTH or 1.0
    out.offsets = -along.mean(axis=1) + rng.uniform(0, out.width, (tables, count))
    queries = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))
    near = sample[queries] @ sample.T
    near[np.arange(len(queries)), queries] = -np.inf
    first = max(1, min(len(sample) - 1, round(k * len(sample) / n)))  # as near as the k-th of all
    best = np.argsort(-near, axis=1)[:, :first]
    norms = np.maximum(np.linalg.norm(sample[queries], axis=1), 1e-300)
    products = np.take_along_axis(near, best, axis=1) * (longest / norms)[:, None]
    out.distance = float(np.sqrt(np.maximum(2 * longest**2 - 2 * products, 0)).mean()) or out.width
    ranks = np.full((len(queries), first), VISITS)
    for t in range(tables):
        keys = out.key(np.floor(out.places(sample, t, False)))
        places = out.places(sample[queries], t, True)
        for i in range(len(queries)):
            at = {key: r for r, key in reversed(list(enumerate(out.probes(places[i], VISITS).tolist())))}
            ranks[i] = np.minimum(ranks[i], [at.get(key, VISITS) for key in keys[best[i]].tolist()])
    out.visits = int(np.quantile(ranks, aim, method="higher")) + 1
    return out if out.visits <= VISITS else None


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: not null, finite, not zero, of the commonest length."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(fine)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("embedding") == (common["d"] if common else 0))


def _met(rows: DataFrame, k: int) -> DataFrame:
    """Of the rows (table, bucket, part, asks, vec_id, embedding): each asking row's k nearest among its part's others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score"]
        at, held_ids, held = None, [], []
        for batch in batches:
            groups = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            ids, vectors = batch.column(4).to_numpy(), _vectors(batch, 5)
            cuts = np.flatnonzero(np.concatenate(([True], (groups[:, 1:] != groups[:, :-1]).any(axis=0) | (asks[1:] != asks[:-1]), [True]))) if len(ids) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                group = tuple(groups[:, a])
                if group != at:
                    at, held_ids, held = group, [], []
                if not asks[a]:
                    held_ids.append(ids[a:b])
                    held.append(vectors[a:b])
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held_ids, held = [np.concatenate(held_ids)], [np.concatenate(held)]
                theirs, block = held_ids[0], held[0]
                for c in range(a, b, 256):
                    q, q_ids = vectors[c : min(c + 256, b)], ids[c : min(c + 256, b)]
                    near = q @ block.T
                    near[q_ids[:, None] == theirs[None, :]] = -np.inf
                    kth = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)]
                    slack = 1e-9 * np.maximum(np.abs(kth), 1e-30)
                    i, j = np.nonzero((near >= (kth - slack)[:, None]) & (near > -np.inf))
                    exact = (q[i] * block[j]).sum(axis=1)  # summed in one order, so that equal vectors tie
                    order = np.lexsort((theirs[j], -exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[keep]]), pa.array(theirs[j[keep]]), pa.array(exact[keep])], names=names)

    dealt = rows.repartition("table", "bucket", "part").sortWithinPartitions("table", "bucket", "part", "asks")
    return dealt.select("table", "bucket", "part", "asks", "vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, aim: float = AIM) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` nearest found of each row whose vec_id ``every`` divides.

    Nearness is the inner product in double precision, ties to the smaller
    vec_id. Rows that are null, zero, not finite or of an odd length take no
    part; of rows with the same id and vector one does, and a row is no candidate
    of its own id; other columns are ignored; an empty table gives no rows. A
    query whose visits meet fewer than ``k`` vectors is held against all, in blocks.
    """
    spark = vectors.sparkSession
    rows = staged(valid(vectors).distinct())
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))).first()
    drawn = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = np.array([r["embedding"] for r in drawn], np.float64).reshape(len(drawn), -1) if drawn else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(fit(sample, n, longest or 0.0, k, tables, aim))

    def keyed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    x = _vectors(part, 1)
                    for t in range(tables):
                        places = hashes.places(x, t, query)
                        if query:
                            keys = [hashes.probes(p, hashes.visits) for p in places]
                            of = np.repeat(np.arange(len(x)), [len(p) for p in keys])
                            key = np.concatenate(keys)
                        else:
                            of, key = np.arange(len(x)), hashes.key(np.floor(places))
                        of = pa.array(of)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), t, np.int32)), pa.array(key), part.column(0).take(of), part.column(1).take(of)], names=["table", "bucket", "vec_id", "embedding"])

        return run

    schema = "table int, bucket long, vec_id long, embedding array<double>"
    index = rows.mapInArrow(keyed(False), schema)
    asking = rows.filter(F.col("vec_id") % every == 0)
    sizes = staged(index.groupBy("table", "bucket").count().select("table", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    dealt = index.join(sizes, ["table", "bucket"]).select("table", "bucket", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "embedding")

    def visits(queries: DataFrame) -> DataFrame:
        parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        return queries.join(sizes, ["table", "bucket"]).select("table", "bucket", parts, F.lit(True).alias("asks"), "vec_id", "embedding")

    def best(found: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    met = staged(_met(dealt.union(visits(asking.mapInArrow(keyed(True), schema))), k))
    found = best(met, k * tables).select("query_id", "vec_id", "score").distinct()
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k, max(n - 1, 0)))
    short = asking.join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if not short.isEmpty():
        everywhere = short.withColumn("table", F.lit(0)).join(sizes.filter("table = 0").select("table", "bucket"), "table").select("table", "bucket", "vec_id", "embedding")
        found = found.union(_met(dealt.filter("table = 0").union(visits(everywhere)), k)).distinct()
    return best(found, k).select("query_id", "rank", "vec_id", "score")

"""Ranked lexical search by pipelined term partitioning.

The documents are read once, in blocks, each of which becomes a row of counts
for every term that an item may hold. Each term has an owner, by the share of
the documents that hold it. For each bundle of items and each block a sparse
accumulator, scores by document, visits the owners one after the other, the
rarest terms first: a cogroup brings it together with the owner's counts of that
block, the owner adds what its terms weigh, and hands it on. The last owner
picks the block's best documents, from which each item's best are taken.

Everything is added in integers, so the order of the owners changes nothing. A
document leaves an accumulator only if all that later owners can add would not
lift it to the scores that as many documents as asked for have already.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._common import staged

#: Hits of an item.
MOST = 10
#: Documents of a block, and bytes of their texts (one text at least).
BLOCK = 4096
BLOCK_BYTES = 1 << 25
#: Items whose accumulators travel together, about.
BUNDLE = 256
#: Bits of the filter through which words go before they are counted: 512 KB, whatever the items; a word let through in error meets no item.
FILTER = 22
#: A term goes to the first owner if at most a 64th of the documents hold it, to the next if at most an eighth do, else to the last.
OWNERS = (64, 8)

#: What stands between terms, the constants of the weights.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No term adds more than this times its weight.
CEILING = 1_000_000

_fold = bytes(32 if i < 0x30 or 0x39 < i < 0x41 or 0x5A < i < 0x61 or 0x7A < i < 0x80 else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8: in it, all bytes of other than ASCII characters are part of terms."""
    return (text or "").encode().translate(_fold).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each."""
    return items.select("item_id", F.explode(F.split(F.translate("text", UPPER, LOWER), SEPARATORS)).alias("term")).filter("term <> ''").distinct()


def blocks(docs: DataFrame, wanted: np.ndarray, block: int) -> DataFrame:
    """For each block and term that ``wanted`` (bits by CRC) lets through, its documents' places (``docs``) and counts (``tfs``); and, without a term, each document's number of terms and its id.

    n_docs and n_terms are the documents and occurrences of a row. Documents without terms are in no block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask, known = np.unpackbits(np.frombuffer(shared.value, np.uint8)), len(wanted) - 1, {}
        first, done = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        sizes: list[int] = []
        found: dict[bytes, list[int]] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            places = [np.array(x, np.int64).reshape(-1, 2) for x in found.values()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + done] * (len(found) + 1), pa.int64()),
                    pa.array([None, *(w.decode() for w in found)], pa.string()),
                    pa.array([len(ids), *map(len, places)], pa.int64()),
                    pa.array([sum(sizes), *(int(p[:, 1].sum()) for p in places)], pa.int64()),
                    pa.array([np.array(sizes, np.int64).tobytes(), *(p[:, 0].astype(np.uint16).tobytes() for p in places)], pa.binary()),
                    pa.array([None, *(p[:, 1].astype(np.uint32).tobytes() for p in places)], pa.binary()),
                    pa.array([ids, *[None] * len(found)], pa.list_(pa.int64())),
                ],
                names=["block", "term", "n_docs", "n_terms", "docs", "tfs", "ids"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                at = len(ids)
                for word, n in Counter(words).items():
                    known_word = known.get(word)
                    if known_word is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        known_word = known[word] = bool(bits[zlib.crc32(word) & mask])
                    if known_word:
                        found.setdefault(word, []).extend((at, n))
                ids.append(doc_id)
                sizes.append(len(words))
                held += len(text)
                if len(ids) >= block or held >= BLOCK_BYTES:
                    yield flush()
                    done += 1
                    ids, sizes, found, held = [], [], {}, 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, term string, n_docs long, n_terms long, docs binary, tfs binary, ids array<long>")


def weight(df: Column, n: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2.0 * df + 1))).cast("long")


def owner_of(df: Column, n: int) -> Column:
    out = F.lit(len(OWNERS))
    for k, share in reversed(list(enumerate(OWNERS))):
        out = F.when(df * share <= n, F.lit(k)).otherwise(out)
    return out


def search(docs: DataFrame, items: DataFrame, most: int = MOST, block: int = BLOCK, bundle: int = BUNDLE) -> DataFrame:
    """item_id, rank, doc_id and score of the ``most`` best documents of every item (item_id, text), among all ``docs`` (doc_id, text).

    A null or empty text has no terms: such an item has no rows, such a document
    is never found and never counted. Rows of one item_id are one item with the
    terms of all; a null item_id is an item like any other. Repeated documents
    rank one after the other; a null doc_id comes before others of the same
    score. Other columns are ignored; an empty table on either side gives no rows.
    """
    if block > 1 << 16:
        raise ValueError("a block has 65,536 documents at most")
    spark = docs.sparkSession
    asked = staged(item_terms(items.select("item_id", "text")))
    wanted = np.zeros(1 << FILTER, bool)
    wanted[[r[0] for r in asked.select(F.crc32("term").bitwiseAND((1 << FILTER) - 1)).distinct().collect()]] = True  # 2**FILTER numbers at most
    index = staged(blocks(docs, wanted, block))
    total = index.filter("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = int(total[0]), int(total[1])
    frequency = index.filter("term is not null").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weighed = asked.join(frequency, "term").select("item_id", F.struct(owner_of(F.col("df"), n_docs).alias("owner"), "term", weight(F.col("df"), n_docs).alias("w")).alias("t"))
    bundles = max(1, -(-asked.select("item_id").distinct().count() // bundle))
    queries = staged(weighed.groupBy("item_id").agg(F.sort_array(F.collect_list("t")).alias("terms")).withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles))))
    owned = staged(queries.select("bundle", F.explode("terms").alias("t")).select("bundle", "t.owner", "t.term").distinct())

    lengths = index.filter("term is null").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long"))).alias("bundle"), F.lit(None).cast("string").alias("term"), "docs", "tfs", "ids")
    nothing = F.lit(b"")
    state = lengths.select("block", "bundle").join(queries, "bundle").select(F.col("bundle").alias("for"), F.col("block").alias("at"), "item_id", "terms", nothing.alias("docs"), nothing.alias("scores"))
    item_type = queries.schema["item_id"].dataType.simpleString()
    stages = len(OWNERS) + 1
    for owner in range(stages):
        counts = index.join(owned.filter(F.col("owner") == owner), "term").select("block", "bundle", "term", "docs", "tfs", F.lit(None).cast("array<long>").alias("ids"))
        right = counts.unionByName(lengths)
        last = owner == stages - 1
        schema = f"item_id {item_type}, doc_id long, score long" if last else state.schema
        state = state.groupBy("for", "at").cogroup(right.groupBy("bundle", "block")).applyInArrow(_visit(owner, last, most, n_docs, n_terms), schema)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = state.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    if not n_terms:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    return ranked.select("item_id", "rank", "doc_id", "score")


def _visit(owner: int, last: bool, most: int, n_docs: int, n_terms: int):
    """What an owner does with the accumulators of a bundle and a block."""

    def visit(state: pa.Table, counts: pa.Table) -> pa.Table:
        counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        lengths, ids = np.zeros(0, np.int64), []
        for term, places, tfs, own_ids in zip(*(counts.column(c).to_pylist() for c in ("term", "docs", "tfs", "ids")), strict=True):
            if term is None:
                lengths, ids = np.frombuffer(places, np.int64), own_ids
            else:
                counted[term] = np.frombuffer(places, np.uint16), np.frombuffer(tfs, np.uint32).astype(np.int64)
        m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
        gains = {term: (places, 1_000_000_000 * tf // (1000 * tf + 8 * m[places])) for term, (places, tf) in counted.items()}
        if last:
            order = np.empty(len(ids), np.int64)
            order[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))] = np.arange(len(ids))
        scores = np.zeros(len(lengths), np.int64)
        out: list[tuple] = []
        for item, terms, places, so_far in zip(*(state.column(c).to_pylist() for c in ("item_id", "terms", "docs", "scores")), strict=True):
            scores[:] = 0
            scores[np.frombuffer(places, np.uint16)] = np.frombuffer(so_far, np.int64)
            later = 0
            for t in terms:
                if t["owner"] > owner:
                    later += t["w"] * CEILING
                elif t["owner"] == owner and t["term"] in gains:
                    places, gain = gains[t["term"]]
                    scores[places] += t["w"] * gain
            held = np.flatnonzero(scores)
            if len(held) > most:
                least = np.partition(scores[held], -most)[-most]
                held = held[scores[held] + later >= least]
            if last:
                held = held[np.lexsort((order[held], -scores[held]))[:most]]
                out += [(item, ids[i], s) for i, s in zip(held.tolist(), scores[held].tolist(), strict=True)]
            else:
                out.append((held.astype(np.uint16).tobytes(), scores[held].tobytes()))
        if last:
            kinds = (state.schema.field("item_id").type, pa.int64(), pa.int64())
            return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else ([], [], []), kinds, strict=True)], names=["item_id", "doc_id", "score"])
        found = list(zip(*out, strict=True)) or [(), ()]
        return pa.table([*(state.column(c) for c in ("for", "at", "item_id", "terms")), pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary())], names=["for", "at", "item_id", "terms", "docs", "scores"])

    return visit

"""Substring dedup by super-k-mer partitioning.

A window is 50 words in a row. Consecutive windows of a text that share their
minimiser (the least hash of the word 5-grams in it) form a super-k-mer. Equal
windows have equal minimisers, so only super-k-mers whose minimiser occurs in
two documents can matter; of those with equal words (the same minimiser, digest
and number of words) the one of the smallest document stands for all. Where a
minimiser has several different super-k-mers, each travels as one packed string
to the minimiser's bucket. There the windows of all strings are sorted exactly,
by their words: ranks of one word give ranks of two, four and so on, so that
memory is in proportion to the words, whatever they repeat. The windows of a
bucket with too many words for one task are sorted by Spark instead, each a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm._common import join_spread, staged, texts_of, with_arrow_columns

WINDOW = 50
GRAM = 5
#: Words of one bucket that one task sorts; Spark sorts the windows of larger ones.
BUCKET = 2_000_000
#: Words that are sorted together at least, if there are as many: small buckets share a sort.
TOGETHER = 300_000

_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))
_STEPS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _ends(words: list[bytes]) -> np.ndarray:
    """Ends of the words when joined by blanks."""
    return np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :])


def super_kmers(text: str, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Minimiser, digest of the words, first word and windows of each super-k-mer of a text."""
    words = text.encode().split()  # bytes: split() knows ASCII white space only
    if len(words) < window:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int32), np.zeros(0, np.int32)
    joined, ends = b" ".join(words), _ends(words)
    starts = np.concatenate(([0], ends[:-1] + 1))
    chars = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
    place = np.arange(len(joined)) - np.repeat(starts, np.diff(np.append(starts, len(joined))))
    hashes = np.add.reduceat(chars * _POWERS[place % len(_POWERS)], starts)
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        grams += (hashes[i : i + len(grams)] ^ (hashes[i : i + len(grams)] >> np.uint64(31))) * _STEPS[i]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    least = _least(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n = np.diff(np.append(first, len(least)))
    digest = xxhash.xxh64_intdigest
    begin, end = starts[first].tolist(), ends[first + n + window - 2].tolist()
    digests = [digest(joined[a:b]) for a, b in zip(begin, end, strict=True)]
    return least[first].view(np.int64), digests, first.astype(np.int32), n.astype(np.int32)


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """The super-k-mers of all documents that have an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for at in range(0, len(texts), 256):
                found = [super_kmers(x, window) for x in texts[at : at + 256]]
                of = pa.array(np.repeat(np.arange(at, at + len(found)), [len(f[1]) for f in found]))
                digests = np.array([d for f in found for d in f[1]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[0] for f in found])), pa.array(digests), batch.column(0).take(of), batch.column(1).take(of), *(pa.array(np.concatenate([f[k] for f in found])) for k in (2, 3))],
                    names=["minimiser", "digest", "doc_id", "text_hash", "start", "n"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.filter("doc_id is not null").select("doc_id", "text_hash", "text")
    return known.mapInArrow(run, f"minimiser long, digest long, doc_id {kind}, text_hash long, start int, n int")


def _packed(asked: DataFrame, kind: str, window: int, apart: bool) -> DataFrame:
    """The packed strings of the super-k-mers listed with each text; if ``apart``, each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["minimiser", "digest", "n", "i", "packed", "doc_id"]
        for batch in batches:
            docs, texts, lists = (batch.column(c) for c in range(3))

            def out(of: list[int], cols: tuple[list, ...], docs=docs) -> pa.RecordBatch:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), docs.take(pa.array(of, pa.int64()))], names=names)

            of, cols, held = [], ([], [], [], [], []), 0
            for row in range(batch.num_rows):
                words = texts[row].as_py().encode().split()
                for w in lists[row].as_py():
                    for i in range(w["n"]) if apart else (0,):
                        at = w["start"] + i
                        packed = b" ".join(words[at : at + (window if apart else w["n"] + window - 1)])
                        of.append(row)
                        for into, x in zip(cols, (w["minimiser"], w["digest"], w["n"], i, packed), strict=True):
                            into.append(x)
                        held += len(packed)
                        if held > 8_000_000:
                            yield out(of, cols)
                            of, cols, held = [], ([], [], [], [], []), 0
            yield out(of, cols)

    return asked.mapInArrow(run, f"minimiser long, digest long, n int, i int, packed binary, doc_id {kind}")


def late_windows(packed: list[bytes], n: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of all windows of the strings, ``n`` of each in a row: whether the words of one also start in a string of a smaller ``doc``."""
    words = b" ".join(packed).split(b" ")
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rank = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    total, width = len(words), 1
    while width * 2 <= window:  # ranks of the runs of ``width`` words from each word on
        rank = np.unique(rank[:-width] * (rank.max() + 1) + rank[width:], return_inverse=True)[1]
        width *= 2
    count, shift = total - window + 1, window - width
    rank = rank[:count] * (rank.max() + 1) + rank[shift : shift + count]
    starts = np.cumsum(n + window - 1) - (n + window - 1)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    kind = np.unique(rank[np.repeat(starts, n) + inside], return_inverse=True)[1]
    own = np.repeat(doc, n)
    least = np.full(kind.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, own)
    return least[kind] < own


def _sorted_windows(packed: DataFrame, window: int) -> DataFrame:
    """Of each string, the windows that a smaller document has, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            minimiser, digest, n, strings, docs = zip(*rows, strict=True)
            place = {d: i for i, d in enumerate(sorted(set(docs)))}
            late = late_windows(list(strings), np.array(n, np.int64), np.array([place[d] for d in docs], np.int64), window)
            ends = np.cumsum(n)
            found = [np.flatnonzero(late[b - k : b]).tolist() for b, k in zip(ends.tolist(), n, strict=True)]
            keep = [i for i, x in enumerate(found) if x]
            pick = lambda x, kind: pa.array([x[i] for i in keep], kind)
            return pa.RecordBatch.from_arrays([pick(minimiser, pa.int64()), pick(digest, pa.int64()), pick(n, pa.int32()), pick(found, pa.list_(pa.int32()))], names=["minimiser", "digest", "n", "late"])

        ready: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("minimiser", "digest", "n", "packed", "doc_id")), strict=True):
                if size > TOGETHER and row[0] != ready[-1][0]:  # equal windows have equal minimisers: whole buckets can be sorted together
                    yield out(ready)
                    ready, size = [], 0
                ready.append(row)
                size += row[2] + window - 1
        if ready:
            yield out(ready)

    return packed.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(run, "minimiser long, digest long, n int, late array<int>")


def repeated_windows(docs: DataFrame, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_hash and ``found``: ranges (first, last) of starts of windows whose words also start in a document with a smaller id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = ["minimiser", "digest", "n"]
    runs = staged(_runs(docs, window))
    shared = runs.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("size"))
    shared = staged(shared.filter("low < high").select("minimiser", "size"))
    runs = staged(join_spread(runs, shared, ["minimiser"], "size", runs.count()))
    strings = staged(runs.groupBy(*key).agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"), F.count("*").alias("copies")).select(*key, "first.*", "copies"))
    several = strings.groupBy("minimiser").agg(F.count("*").alias("size"), F.sum(F.col("n") + (window - 1)).alias("words")).filter("size > 1")
    several = staged(several.select("minimiser", "size", (F.col("words") > bucket).alias("large")))

    def texts(large: bool) -> DataFrame:
        listed = join_spread(strings, several.filter(F.col("large") == large).drop("large"), ["minimiser"], "size", strings.count())
        asked = listed.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_list(F.struct(*key, "start")).alias("wanted"))
        return docs.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_hash").eqNullSafe(F.col("hash"))).select("doc_id", "text", "wanted")

    inner = staged(_sorted_windows(_packed(texts(False), kind, window, False), window))
    if not several.filter("large").isEmpty():
        split = staged(_packed(texts(True), kind, window, True))
        least = staged(split.groupBy("packed").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
        late = join_spread(split, least, ["packed"], "size", split.count()).filter("least < doc_id")
        inner = inner.union(late.groupBy(*key).agg(F.array_sort(F.collect_set("i")).alias("late")))
    firsts = strings.withColumnRenamed("doc_id", "least").select(*key, "least", "copies").join(inner, key, "left").filter("copies > 1 or late is not null")
    placed = join_spread(runs, staged(firsts), key, "copies", runs.count()).filter("doc_id > least or late is not null")
    all_of_it = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") - 1).alias("b")))
    some = F.transform("late", lambda i: F.struct((F.col("start") + i).alias("a"), (F.col("start") + i).alias("b")))
    ranges = F.when(F.col("doc_id") > F.col("least"), all_of_it).otherwise(some)
    return placed.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list(ranges)).alias("found"))


def dedup(docs: DataFrame, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one blank) of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words over it also starts in a document
    with a smaller doc_id. A null or empty text has no words; a row without an id
    loses nothing and takes nothing; rows with the same id do not count against
    each other; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    marks = repeated_windows(docs, window, bucket).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    joined = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_hash").eqNullSafe(F.col("hash")), "left").select("doc_id", "text", "found")

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            total, removed, kept = [], [], []
            for text, found in zip(texts_of(batch), batch.column(batch.schema.names.index("found")).to_pylist(), strict=True):
                words = text.encode().split()
                total.append(len(words))
                if found:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, [r["a"] for r in found], 1)
                    np.add.at(step, [r["b"] + window for r in found], -1)
                    stays = np.cumsum(step[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            return [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

        return compute

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return with_arrow_columns(joined, fields, make).select("doc_id", "n_words", "n_removed", "kept")

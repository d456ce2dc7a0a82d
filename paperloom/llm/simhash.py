"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two
fingerprints at four or fewer differing bits fall into one of two cases:

* one segment is equal: of the other bits, cut into fifths, one fifth is equal
  too, and the segment with that fifth is their common key;
* every segment differs, so two of them differ in exactly one bit each. A
  segment read as a word of the perfect (23, 12) Golay code decodes to the only
  codeword within three errors; after one more flipped bit that codeword is
  still within four. So one side emits the pair of its own codeword indices,
  the other all pairs of codeword indices within four errors, and both add the
  segments' parities (one flipped bit turns a parity around).

No pair is lost, and every pair found is verified on the whole fingerprints. A
bitmap of the pair keys that are asked for, one bit for each key that there can
be, keeps all others from being shipped. Where too many fingerprints ask or
answer under a key, either side is dealt to groups, and every two groups meet in
a task of their own: nothing is compared less, only elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm._common import join_spread, own, staged, texts_of, with_arrow_columns
from paperloom.llm.components import connected_components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: Fingerprints that ask, and that answer, under one key in one task; where there are more, they are dealt to groups.
BUCKET = 20_000
#: Bits of a pair key: two codeword indices, two parities, and which segments they are of.
PAIR_BITS = 28
#: Distinct fingerprints whose keys one task makes.
SPREAD = 1 << 14

#: Generator polynomial of the (23, 12) Golay code.
GOLAY = 0b110001110101
#: Lowest bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def simhash(text: str, width: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64; no words: 0."""
    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]), np.uint8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 19):
        ones += np.unpackbits(hashes[i : i + (1 << 19)]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, name: str, width: int = SHINGLE) -> DataFrame:
    """``docs`` (a column ``text``) and its fingerprint as a signed long."""

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = np.fromiter((simhash(x, width) for x in texts_of(batch)), np.uint64, batch.num_rows)
            return [pa.array(found.view(np.int64))]

        return compute

    return with_arrow_columns(docs, [T.StructField(name, T.LongType())], make)


class Golay:
    """Decoding tables of the (23, 12) code, built from its generator polynomial."""

    def __init__(self) -> None:
        rest = np.arange(1 << 23, dtype=np.int32)
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
        self.syndrome = rest.astype(np.int16)
        patterns: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                patterns[self.syndrome[e]].append(e)  # the first is the coset leader, of weight 3 at most
        self.lists = np.full((2048, max(map(len, patterns))), -1, np.int32)
        for s, own_patterns in enumerate(patterns):
            self.lists[s, : len(own_patterns)] = own_patterns

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """The index of the one codeword within three errors."""
        return (words ^ self.lists[self.syndrome[words], 0]) >> 11

    def near(self, words: np.ndarray) -> np.ndarray:
        """Indices of the codewords within four errors, the nearest first, padded with -1."""
        errors = self.lists[self.syndrome[words]]
        return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def fifths(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint fifteen keys, of a segment and a fifth of the other bits: at four flipped bits outside the segment one of its five is equal."""
    out = np.zeros((len(prints), len(SEGMENTS) * (MOST_BITS + 1)), np.int64)
    for i, (low, width) in enumerate(SEGMENTS):
        segment = (prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        others, turn = 64 - width, (low + width) % 64
        p = prints >> np.uint64(turn) | prints << np.uint64(64 - turn) if turn else prints  # the other bits come lowest
        for j in range(MOST_BITS + 1):
            a, b = j * others // (MOST_BITS + 1), (j + 1) * others // (MOST_BITS + 1)
            fifth = (p >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            out[:, i * (MOST_BITS + 1) + j] = ((segment << 9 | fifth) << 5 | j << 2 | i) << 2 | 3
    return out


def keys_of(prints: np.ndarray, answers: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct fingerprints (uint64): keys, the row of each key, and whether the row asks under it; only keys that ask if not ``answers``."""
    code, n = golay(), len(prints)
    segments = [((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near = [code.near(s).astype(np.int64) if answers else code.nearest(s).astype(np.int64)[:, None] for s in segments]
    odd = [np.bitwise_count(s).astype(np.int64) & 1 for s in segments]
    rows, same = np.arange(n), fifths(prints)
    keys, of, asks = [same.ravel()], [np.repeat(rows, same.shape[1])], [np.ones(same.size, bool)]
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        def key(a, b, p, q, k=k):
            return ((a << 12 | b) << 2 | p << 1 | q) << 2 | k

        keys.append(key(near[i][:, 0], near[j][:, 0], odd[i], odd[j]))
        of.append(rows)
        asks.append(np.ones(n, bool))
        if answers:
            both = (near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0)
            r, x, y = np.nonzero(both)
            keys.append(key(near[i][r, x], near[j][r, y], 1 - odd[i][r], 1 - odd[j][r]))
            of.append(r)
            asks.append(np.zeros(len(r), bool))
    return np.concatenate(keys), np.concatenate(of), np.concatenate(asks)


def forest(members: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect what links of at most ``most`` bits connect among the fingerprints; fewer edges than members."""
    left, right = [], []
    rest = np.unique(members)
    queue: list[np.uint64] = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        at = queue.pop()
        hit = np.bitwise_count(rest ^ at) <= most
        if hit.any():
            found = rest[hit]
            left.append(np.full(len(found), at))
            right.append(found)
            queue.extend(found)
            rest = rest[~hit]
    return left, right


def bucket_edges(key: np.ndarray, print_: np.ndarray, asks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the buckets of rows sorted by key."""
    if not len(key):
        return print_[:0], print_[:0]
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(bounds)
    useful = (sizes > 1) & (np.add.reduceat(asks.astype(np.int64), bounds[:-1]) > 0)
    left, right = [], []
    small = useful & (sizes <= 32)
    take = np.repeat(small, sizes)
    k, p = key[take], print_[take]
    step = 1
    while step < len(k) and (same := k[step:] == k[:-step]).any():
        a, b = p[:-step][same], p[step:][same]
        hit = (np.bitwise_count(a ^ b) <= most) & (a != b)
        left.append(a[hit])
        right.append(b[hit])
        step += 1
    for b in np.flatnonzero(useful & (sizes > 32)):
        more = forest(print_[bounds[b] : bounds[b + 1]], most)
        left += more[0]
        right += more[1]
    if not left:
        return print_[:0], print_[:0]
    return np.concatenate(left), np.concatenate(right)


KEYED = "key long, fp long, asks boolean"


def _asked(prints: DataFrame) -> DataFrame:
    """The pair keys under which fingerprints ask, as a bitmap: a row (at, bits) for each stretch of it that has a bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = keys_of(batch.column(0).to_numpy().view(np.uint64), answers=False)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[key & 3 < 3]))], names=["key"])

    keys = prints.mapInArrow(run, "key long")
    at, bit = F.call_function("bitmap_bucket_number", F.col("key") + 1), F.call_function("bitmap_bit_position", F.col("key") + 1)  # buckets begin with 1
    return keys.groupBy((at - 1).alias("at")).agg(F.call_function("bitmap_construct_agg", bit).alias("bits"))


def linked(prints: DataFrame, most: int = MOST_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in the column ``fp`` that connect all that lie within ``most`` bits."""
    if most > MOST_BITS:
        raise ValueError(f"the keys find pairs of at most {MOST_BITS} bits")

    distinct = staged(prints.select("fp").distinct())
    spread = distinct.repartition(max(1, -(-distinct.count() // SPREAD)), "fp")
    asked = staged(_asked(spread))
    shared = prints.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1])) for r in asked.collect()])  # 2**PAIR_BITS bits at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << PAIR_BITS >> 3, np.uint8)
        for at, some in shared.value:
            bits[at * len(some) : (at + 1) * len(some)] = np.frombuffer(some, np.uint8)
        for batch in batches:
            all_prints = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_prints), 2048):
                some = all_prints[at : at + 2048]
                key, row, asks = keys_of(some)
                keep = asks.copy()
                answering = key[~asks]
                keep[~asks] = bits[answering >> 3] >> (answering & 7) & 1
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(some[row[keep]].view(np.int64)), pa.array(asks[keep])], names=["key", "fp", "asks"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
            key, part, fp, asks = (np.concatenate(x) for x in zip(*rows, strict=True))
            group = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
            a, b = bucket_edges(group, fp.view(np.uint64), asks, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[list[np.ndarray]] = []  # the rows of the last group, which may go on
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            if not len(cols[0]):
                continue
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][0], cols[1][0])):
                rows = [*held, [c[:cut] for c in cols]] if cut else held
                held = []
                yield out(rows)
            held.append([c[cut:] for c in cols])
        if held:
            yield out(held)

    keyed = staged(spread.mapInArrow(emit, KEYED))
    one_kind = F.col("key").bitwiseAND(3) == 3
    sides = keyed.groupBy("key").agg(F.count_if("asks").alias("n_asks"), F.count_if(~F.col("asks")).alias("n_answers"))
    groups = [F.greatest(F.ceil(F.col(c) / bucket), F.lit(1)).cast("long").alias(g) for c, g in (("n_asks", "asking"), ("n_answers", "answering"))]
    hot = staged(sides.filter((F.col("n_asks") > bucket) | (F.col("n_answers") > bucket)).select("key", *groups))
    if hot.isEmpty():
        keyed = keyed.select("key", F.lit(0).cast("long").alias("part"), "fp", "asks")
    else:
        # who asks meets who answers at each crossing of their groups; where all ask, every two groups meet
        one = F.lit(1).cast("long")
        keyed = keyed.join(hot, "key", "left").withColumn("asking", F.coalesce("asking", one)).withColumn("answering", F.coalesce("answering", one))
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        mine = F.pmod(F.xxhash64("fp"), F.when(F.col("asks"), F.col("asking")).otherwise(F.col("answering")))
        two = F.transform(F.filter(upto(F.col("asking")), lambda g: g != mine), lambda g: F.greatest(g, mine) * F.col("asking") + F.least(g, mine))
        crossing = F.when(F.col("asks"), F.transform(upto(F.col("answering")), lambda g: mine * F.col("answering") + g)).otherwise(F.transform(upto(F.col("asking")), lambda g: g * F.col("answering") + mine))
        to = F.when((F.col("asking") == 1) & (F.col("answering") == 1), F.array(F.lit(0).cast("long"))).when(one_kind, two).otherwise(crossing)
        keyed = keyed.select("key", F.explode(to).alias("part"), "fp", "asks")
    return keyed.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(reduce, "a long, b long")


def near_duplicates(docs: DataFrame, most: int = MOST_BITS, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp and component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach. A null or empty text
    has fingerprint zero and links like any other; a null doc_id is never the
    smallest (null where a component has no other id); repeated rows stay; other
    columns are ignored; an empty table gives no rows.
    """
    return _rooted(docs, most, width).drop(own("root"))


def _rooted(docs: DataFrame, most: int, width: int) -> DataFrame:
    """``near_duplicates`` and the smallest fingerprint of each row's component."""
    prints = staged(fingerprints(docs.select("doc_id", "text"), "fp", width).select("doc_id", F.xxhash64("text").alias("text_hash"), "fp"))
    groups = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    edges = staged(linked(groups, most).distinct())
    root = own("root")
    roots = connected_components(edges).select(F.col("node").alias("fp"), F.col("root").alias(root))
    firsts = staged(groups.join(roots, "fp", "left").withColumn(root, F.coalesce(root, "fp")))
    smallest = staged(firsts.groupBy(root).agg(F.min("first").alias("component_id"), F.count("*").alias("size")))
    n = firsts.count()
    named = staged(join_spread(firsts, smallest, [root], "size", n).select("fp", "component_id", root, "n"))
    return join_spread(prints, named, ["fp"], "n", prints.count()).select("doc_id", "text_hash", "fp", "component_id", root)


def keep_one(docs: DataFrame, most: int = MOST_BITS, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without their near-duplicates: of each component the document with the smallest id stays, all columns kept.

    Rows without an id cannot name their component's first document: they stay
    where no row of their component has an id, one of each text.
    """
    mark, rank = own("mark", docs), own("rank", docs)
    found = _rooted(docs, most, width)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # of rows with the same id and component one text stays
    kept = kept.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("fp")).otherwise(F.col(own("root"))).alias("fp")).agg(F.min("text_hash").alias("text_hash"))
    ids = kept.select(F.col("doc_id").alias(own("id", docs)), F.col("text_hash").alias(mark))
    hit = docs.join(ids, F.col(own("id", docs)).eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col(mark)), "left_semi")
    same = Window.partitionBy("doc_id", mark).orderBy(mark)
    return hit.withColumn(mark, F.xxhash64("text")).withColumn(rank, F.row_number().over(same)).filter(F.col(rank) == 1).select(*docs.columns)

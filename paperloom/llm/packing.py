"""Best-fit packing by exact-complement hashing.

Only lengths matter to where pieces go, and there are as many lengths as a
sequence has tokens. So the plan is made on counts by length, whose size does
not grow with the data: for the longest length left, look up single, pair and
triple sums that fill its gap exactly among the lengths still available, and
use each combination as often as the counts allow; then pack the rest best-fit,
longest first. The plan's patterns name ranges of ranks within each length;
Spark numbers the pieces of each length and every piece looks up its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._common import staged
from paperloom.llm.tokens import WordTokenizer

ROOM = 2048
#: Groups at least into which the pieces of one length are dealt before they are numbered, and pieces of a group at most, about.
DEAL = 256
GROUP = 50_000


@dataclass
class Plan:
    """For each range of ranks of a length: its first rank, its first sequence and its offset there; sorted by length and rank."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length << 44 | self.rank, length << 44 | rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def _fill(counts: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths with the sum ``gap``; the fewest, and of those the longest first."""
    if counts[gap]:
        return [gap]
    half = gap // 2
    if half:
        first = np.arange(gap - 1, gap - half - 1, -1)
        ok = (counts[first] > 0) & (counts[gap - first] > 0)
        if gap % 2 == 0 and counts[half] < 2:
            ok[-1] = False
        if ok.any():
            a = int(first[ok.argmax()])
            return [a, gap - a]
    for a in np.flatnonzero(counts[: gap - 1])[::-1].tolist():
        if a * 3 < gap:  # the first of three is the longest
            break
        rest = gap - a
        b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
        ok = (counts[b] > 0) & (counts[rest - b] > 0)
        need = 1 + (b == a)
        ok &= counts[b] >= need + (b == rest - b)
        if ok.any():
            b = int(b[ok.argmax()])
            return [a, b, rest - b]
    return None


def plan(counts: np.ndarray, room: int = ROOM) -> Plan:
    """``counts[n]``: pieces of length n, up to ``room``."""
    left = counts.astype(np.int64).copy()
    used = np.zeros(room + 1, np.int64)
    rows: list[tuple[int, int, int, int]] = []
    sequences = 0

    def use(pattern: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n in pattern:
            rows.append((n, int(used[n]), sequences, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequences += times

    def times(pattern: list[int]) -> int:
        return min(int(left[n]) // pattern.count(n) for n in set(pattern))

    for n in range(room, 0, -1):  # exact complements; every use empties a length, but for one left of a pair or triple
        while left[n]:
            left[n] -= 1
            more = _fill(left, room - n) if n < room else []
            left[n] += 1
            if more is None:
                break
            use([n, *more], times([n, *more]))
    for n in range(room, 0, -1):  # best fit: the longest that still fits
        while left[n]:
            pattern, gap = [n], room - n
            while gap:
                now = left[: gap + 1].copy()
                for m in set(pattern):
                    if m <= gap:
                        now[m] -= pattern.count(m)
                fits = np.flatnonzero(now[1:] > 0)
                if not len(fits):
                    break
                m = int(fits[-1]) + 1
                pattern.append(m)
                gap -= m
            use(pattern, times(pattern))
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*cols, sequences)


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every row's whole text (a null text is empty).

    A document is its token ids and the id 0; one longer than ``room`` is cut so
    that all pieces but the first have that length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(WordTokenizer.source(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer.of(shared.value).encode_bytes
        kind = None
        for batch in batches:
            kind, of, out = batch.schema.field("doc_id").type, [], ([], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                end = n % room or room
                start = 0
                for piece in range(-(-n // room)):
                    of.append(i)
                    end = min(end, n)
                    for into, x in zip(out, (piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])), strict=True):
                        into.append(x)
                    start, end = end, end + room
            cols = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([("doc_id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, deal: int | None = None) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text) with sequence_id and offset, in sequences of ``room`` tokens at most.

    A null or empty text is the one token 0; equal rows are packed each by
    itself; a null doc_id stays null; other columns are ignored; an empty table
    gives no rows. Sequences are filled without gaps from offset 0.
    """
    cut = staged(pieces(docs, tokenizer, room))
    counts = np.zeros(room + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``room`` rows
        counts[r["length"]] = r["count"]
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, room))
    deal = deal or max(DEAL, int(counts.max()) // GROUP)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deal)).cast("int"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    numbered = dealt.withColumn("inside", inside).join(before, ["length", "part"])
    numbered = numbered.select(*cut.columns, (F.col("before") + F.col("inside") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            sequence, offset = shared.value.place(*(batch.column(names.index(c)).to_numpy() for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")

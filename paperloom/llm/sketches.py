"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs are its lines, line ends included; a long line is cut
further where its bytes say so: after a byte at which a hash of the last eight
has six zero bits, whatever the language. Each occurrence of a paragraph has a
64-bit digest that is hashed into three cells; a cell holds the count, the
exclusive or of its digests and that of their checks. Sketches of two versions
subtract cell by cell: what they share cancels, and peeling cells with a single
digest recovers those that differ. Where peeling stops early, both are sketched
again with more cells. All documents of a batch are sketched and peeled at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a fingerprint (a multiple of three).
CELLS = 24
#: Cells a digest at which a sketch that still does not peel is given up for the digests themselves.
MOST_CELLS = 64
#: Bytes that the hash of a cutting place spans, and zero bits that it needs.
SPAN = 8
ZEROS = 6
#: Bytes looked at together; characters that are sketched together; bytes of a range of documents, about.
SLICE = 1 << 20
TOGETHER = 2_000_000
RANGE = 32 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)
_SHIFTS = np.array([[4], [24], [44]], np.uint64)
_THIRDS = np.array([[0], [1], [2]], np.uint64)


def cuts(data: bytes) -> np.ndarray:
    """Ends of the paragraphs of a text's bytes."""
    found = []
    for at in range(0, len(data), SLICE):
        before = min(at, SPAN - 1)
        part = bytes(SPAN - 1 - before) + data[at - before : at + SLICE]
        n = len(part) - SPAN + 1
        last = np.ndarray((n,), "<u8", part, strides=(1,))  # the eight bytes that end at each byte
        place = (last * _MIX >> np.uint64(64 - ZEROS) == 0) | (last >> np.uint64(56) == 10)
        found.append(np.flatnonzero(place) + at + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    return ends if not len(data) or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def raw_digests(text: str) -> np.ndarray:
    """Digest of each paragraph."""
    data = text.encode("utf-8", "surrogatepass")
    ends = cuts(data).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)), np.uint64, len(ends))


def numbered(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The digests made distinct within each document: repeated ones by the number of their occurrence."""
    order = np.lexsort((keys, docs))
    k, d = keys[order], docs[order]
    first = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    again = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
    out = np.empty_like(keys)
    with np.errstate(over="ignore"):
        k = k + again.astype(np.uint64) * _MIX2
        out[order] = np.where(again > 0, (k ^ k >> np.uint64(29)) * _MIX, k)
    return out


def digests(text: str) -> np.ndarray:
    """Distinct digests of the paragraphs; a repeated paragraph's occurrences differ."""
    keys = raw_digests(text)
    return numbered(keys, np.zeros(len(keys), np.int64))


@dataclass
class Sketches:
    """Sketches of several documents, a row each."""

    count: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, cells: int) -> np.ndarray:
        """The cell of each key in each third."""
        third, mixed = np.uint64(cells // 3), keys * _MIX
        return ((mixed >> _SHIFTS) % third + _THIRDS * third).astype(np.int64)

    @staticmethod
    def check(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(32)) * _MIX2) >> np.uint64(32)

    @classmethod
    def of(cls, keys: np.ndarray, docs: np.ndarray, n: int, cells: int = CELLS) -> Sketches:
        """Of ``keys``, each of the document whose number is in ``docs``."""
        out = cls(np.zeros((n, cells), np.int64), np.zeros((n, cells), np.uint64), np.zeros((n, cells), np.uint64))
        out.put(keys, docs, np.ones(len(keys), np.int64))
        return out

    def put(self, keys: np.ndarray, docs: np.ndarray, sign: np.ndarray) -> None:
        """Adds keys, or takes them away."""
        check, cells = self.check(keys), self.count.shape[1]
        for at in self.places(keys, cells):
            at = docs * cells + at
            np.add.at(self.count.reshape(-1), at, sign)
            np.bitwise_xor.at(self.keys.reshape(-1), at, keys)
            np.bitwise_xor.at(self.checks.reshape(-1), at, check)

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks)

    def rows(self, which: np.ndarray) -> Sketches:
        return Sketches(self.count[which], self.keys[which], self.checks[which])

    def guess(self) -> np.ndarray:
        """About how many digests differ: each adds one or takes one from three cells, so their squares add up."""
        n, cells = self.count.sum(axis=1) // 3, self.count.shape[1]
        return np.maximum(np.abs(n), (np.square(self.count).sum(axis=1) - (3 * n) ** 2 / cells) / 3).astype(np.int64)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, digest and side (1: only the first version has it, -1: only the second) of all that differs, and which documents were told whole."""
        left = Sketches(self.count.copy(), self.keys.copy(), self.checks.copy())
        n, cells = self.count.shape
        docs, keys, signs = [], [], []
        for _ in range(cells + 1):  # a cell that only looks single could be peeled back and forth
            pure = np.flatnonzero(np.abs(left.count.reshape(-1)) == 1)
            key = left.keys.reshape(-1)[pure]
            ok = self.check(key) == left.checks.reshape(-1)[pure]
            pure, key = pure[ok], key[ok]
            if not len(pure):
                break
            doc, sign = pure // cells, left.count.reshape(-1)[pure]
            order = np.lexsort((key, doc))
            doc, key, sign = doc[order], key[order], sign[order]
            first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
            doc, key, sign = doc[first], key[first], sign[first]
            docs.append(doc)
            keys.append(key)
            signs.append(sign)
            left.put(key, doc, -sign)
        doc, key, sign = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((docs, np.int64), (keys, np.uint64), (signs, np.int64)))
        whole = ~(left.count.any(axis=1) | left.keys.any(axis=1) | left.checks.any(axis=1))
        order = np.lexsort((key, doc))  # a digest peeled twice was never single
        again = np.flatnonzero((doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])) if len(doc) else np.zeros(0, np.int64)
        whole[doc[order][again]] = False
        return doc, key, sign, whole

    def texts(self) -> list[str]:
        """Of each sketch its paragraphs, then each cell's count, digests and checks, in base 64."""
        n = (self.count.sum(axis=1) // 3).tolist()
        rows = zip(n, self.count.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u4"), strict=True)
        return [f"{k}:" + base64.b64encode(c.tobytes() + d.tobytes() + e.tobytes()).decode() for k, c, d, e in rows]


def picked(keys: np.ndarray, docs: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some documents, which are numbered anew in that order."""
    new = np.full(n, -1)
    new[which] = np.arange(len(which))
    keep = new[docs] >= 0
    return keys[keep], new[docs[keep]]


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS, bases: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, digest and side of all that differs between two versions (digests, document numbers) of ``n`` documents.

    Peeled from sketches, larger ones after each failure: the first retry is as
    large as the counts of the failed sketch make likely, later ones twice as
    large each. What does not peel at ``MOST_CELLS`` cells a digest is told from
    the digests themselves.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(found: tuple[np.ndarray, ...], which: np.ndarray) -> np.ndarray:
        doc, key, sign, whole = found
        good = whole[doc]
        out.append((which[doc[good]], key[good], sign[good]))
        return which[~whole]

    left = bases or Sketches.of(*a, n, cells).minus(Sketches.of(*b, n, cells))
    guess = left.guess()
    small = np.flatnonzero(guess <= cells)
    failed = keep(left.rows(small).peel(), small)
    size = np.full(n, cells)
    size[guess > cells] = cells << np.ceil(np.log2(np.maximum(1.5 * guess[guess > cells] / cells, 1))).astype(np.int64)
    size[failed] *= 2
    todo = np.flatnonzero((guess > cells) | np.isin(np.arange(n), failed))
    total = np.bincount(a[1], minlength=n) + np.bincount(b[1], minlength=n)
    while len(todo):
        given_up = todo[size[todo] > MOST_CELLS * total[todo] + 2 * cells]
        if len(given_up):
            (p, q), (r, s) = picked(*a, given_up, n), picked(*b, given_up, n)
            both = np.lexsort((np.concatenate((p, r)), np.concatenate((q, s))))
            key, doc, sign = np.concatenate((p, r))[both], np.concatenate((q, s))[both], np.concatenate((np.ones(len(p), np.int64), -np.ones(len(r), np.int64)))[both]
            same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
            lone = ~(np.append(same, False) | np.append(False, same))
            out.append((given_up[doc[lone]], key[lone], sign[lone]))
            todo = np.setdiff1d(todo, given_up)
            continue
        now = todo[size[todo] == size[todo].min()]
        now = now[: max(1, (1 << 20) // int(size[now[0]]))]
        (p, q), (r, s) = picked(*a, now, n), picked(*b, now, n)
        found = Sketches.of(p, q, len(now), int(size[now[0]])).minus(Sketches.of(r, s, len(now), int(size[now[0]]))).peel()
        failed = keep(found, now)
        todo = np.setdiff1d(todo, np.setdiff1d(now, failed))
        size[failed] *= 2
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def difference(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Digests that only the first, and only the second of two versions has."""
    _, key, sign = differences((a, np.zeros(len(a), np.int64)), (b, np.zeros(len(b), np.int64)), 1, cells)
    return key[sign > 0], key[sign < 0]


def likenesses(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS, bases: Sketches | None = None) -> np.ndarray:
    """Of each document, the digests that both versions share by all their digests; two versions without any are alike."""
    differ = np.bincount(differences(a, b, n, cells, bases)[0], minlength=n)
    both = (np.bincount(a[1], minlength=n) + np.bincount(b[1], minlength=n) - differ) // 2
    return np.where(both + differ > 0, both / np.maximum(both + differ, 1), 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame, buckets: int | None) -> tuple[DataFrame, int]:
    """The rows in ranges of ids; the first of each range also ends the range before it (the very first: the last range)."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a whole number: the documents follow one another in its order")
    size = F.sum(F.octet_length("text"))
    low, nulls, total = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull()), size).first()
    buckets = buckets or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // RANGE))
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * buckets)).alias("bounds")).first()["bounds"] if shares else None
    bounds = np.array(sorted({b for b in found or [] if b != low}), np.int64)
    very_first = None if nulls else low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            place = np.searchsorted(bounds, np.array([low if x is None else x for x in ids], np.int64), side="right") if low is not None else np.zeros(len(ids), np.int64)
            heads = [i for i, x in enumerate(ids) if x == very_first or (x is not None and place[i] and bounds[place[i] - 1] == x)]
            of = [*range(len(ids)), *heads]
            bucket = [*place, *((place[i] - 1 if ids[i] != very_first else len(bounds)) for i in heads)]
            ahead = [False] * len(ids) + [True] * len(heads)
            picked_rows = batch.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked_rows.columns, pa.array(bucket, pa.int32()), pa.array(ahead)], names=[*batch.schema.names, "bucket", "ahead"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text string, text_hash long, bucket int, ahead boolean"), len(bounds) + 1


def described(docs: list, texts: list[str], follows: list[bool], cells: int = CELLS) -> list[list]:
    """Columns of the result for the rows whose next (the row after it) is at hand: id, n_chars, edited text, both fingerprints, near_edited and near_next."""
    rows = [i for i, f in enumerate(follows) if f]
    new = [edited(texts[i], texts[i + 1]) for i in rows]

    def keyed(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [raw_digests(x) for x in some]
        of = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        return numbered(np.concatenate(raw) if raw else np.zeros(0, np.uint64), of), of

    (keys, of), changed = keyed(texts), keyed(new)
    base, other = Sketches.of(keys, of, len(texts), cells), Sketches.of(*changed, len(new), cells)
    here, there = np.array(rows, np.int64), np.array(rows, np.int64) + 1
    old, following = picked(keys, of, here, len(texts)), picked(keys, of, there, len(texts))
    near_edited = likenesses(old, changed, len(rows), cells, base.rows(here).minus(other))
    near_next = likenesses(old, following, len(rows), cells, base.rows(here).minus(base.rows(there)))
    return [[docs[i] for i in rows], [len(texts[i]) for i in rows], new, base.rows(here).texts(), other.texts(), near_edited.tolist(), near_next.tolist()]


def fingerprint(docs: DataFrame, buckets: int | None = None, cells: int = CELLS) -> DataFrame:
    """doc_id, n_chars, edited (the text with its last half replaced by the next document's beginning), fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The next document is that of the next doc_id, after the last the first; a
    null doc_id comes before all others, and rows with the same id follow by a
    hash of their texts. A doc_id that is no whole number is refused. A null or
    empty text has no paragraphs; two such are alike. Other columns are ignored;
    an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    dealt, ranges = _dealt(docs, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = None
        ids: list = []
        texts: list[str] = []
        places: list[int] = []
        ends: list[bool] = []
        held = 0

        def out() -> pa.RecordBatch:
            follows = [i + 1 < len(ids) and not ends[i] and places[i] == places[i + 1] for i in range(len(ids))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(described(ids, texts, follows, cells), kinds, strict=True)], names=names)

        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for doc, text, bucket, ahead in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("doc_id", "text", "bucket", "ahead")), strict=True):
                for into, x in ((ids, doc), (texts, text), (places, bucket), (ends, ahead)):
                    into.append(x)
                held += len(text)
                if held > TOGETHER or len(ids) > 1000:
                    yield out()
                    for into in (ids, texts, places, ends):
                        del into[:-1]  # the last waits for its next
                    held = len(texts[0])
        if kinds and len(ids) > 1:
            yield out()

    placed = dealt.repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "doc_id", "text_hash")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

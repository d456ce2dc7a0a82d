"""Language identification.

The text's letters, lower case, are cut into subwords: runs of one to three
characters within a word, its edges included. Their hashed embeddings are
averaged and a linear softmax names the language. Embeddings and softmax are
trained by stochastic gradient descent in numpy on a bounded sample; a second
part of the sample sets the softmax's temperature and the score under which a
text is rejected.

Chances among languages alone cannot tell a text that is in none of them. So the
softmax has one class more, learned from counterparts of the sample's texts:
their letters drawn anew, exchanged for others, or moved to other scripts. What
that class takes is missing from the chance of the best language, the score.
Whole texts, passages of any length and counterparts are learned from alike, as
a text may be a word or a book.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm._common import chunks, may_train, own, texts_of, with_arrow_columns

BUCKETS = 4096
DIM = 16
#: Labelled rows that training reads at most, and labels that it learns at most (the most frequent).
SAMPLE = 2400
LABELS = 256
#: Share of rightly named calibration texts that rejection may lose.
LOSS = 0.002
#: First code point and number of letters of scripts to which counterparts are moved.
SCRIPTS = ((0x3B1, 25), (0x430, 32), (0x561, 38), (0x5D0, 27), (0x627, 36), (0x905, 50), (0xB85, 30), (0x3042, 80), (0x30A2, 80), (0x4E00, 3000), (0x4E00, 20000), (0xAC00, 11000))
WORDS = re.compile(r"\S+")
#: Words of a passage at most, and seed of what is drawn.
LONGEST = 200
SEED = 7

_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter[0]


def subword_counts(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """A row for each text: how often its subwords fall into each bucket."""
    lower = [x.lower() for x in texts]
    points = np.frombuffer(("\0" + "\0".join(lower) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in lower])
    doc = np.concatenate((doc[:1], doc))
    a = np.where(letters()[points], points, np.uint32(0))
    keep = np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))
    a, doc = a[keep], doc[keep]
    mix = a * np.uint32(2654435761)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    codes = []
    one = a != 0
    codes.append(doc[one] * buckets + ((mix[one] * np.uint32(0x85EBCA6B)) >> shift))
    two = (mix[:-1] * np.uint32(31) ^ mix[1:]) * np.uint32(0xC2B2AE35)
    codes.append(np.where(a[1:] != 0, doc[1:], doc[:-1]) * buckets + (two >> shift))
    mid = a[1:-1] != 0
    three = (((mix[:-2] * np.uint32(31) ^ mix[1:-1]) * np.uint32(131) ^ mix[2:]) * np.uint32(0x27D4EB2F))[mid]
    codes.append(doc[1:-1][mid] * buckets + (three >> shift))
    return np.bincount(np.concatenate(codes).astype(np.int64), minlength=len(texts) * buckets).reshape(len(texts), buckets)


def averages(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Subword frequencies of each text, and whether it has a letter."""
    counts = subword_counts(texts, buckets).astype(np.float32)
    total = counts.sum(axis=1, keepdims=True)
    return counts / np.maximum(total, 1), np.array([any(map(str.isalpha, x)) for x in texts], bool)


def passage(text: str, rng: random.Random, least: int = 1) -> str:
    """Consecutive words of a text, from ``least`` on, short ones as often as long ones."""
    words = WORDS.findall(text)
    n = min(len(words), int(least * (LONGEST / least) ** rng.random()))
    at = rng.randint(0, len(words) - n)
    return " ".join(words[at : at + n])


def counterpart(text: str, rng: random.Random) -> str:
    """A text with the words' lengths and signs of ``text``, in no language: its letters drawn anew, exchanged, or moved to another script."""
    letters, kind = "abcdefghijklmnopqrstuvwxyz", rng.randrange(4)
    if kind == 0:
        return "".join(rng.choice(letters) if c.isalpha() else c for c in text)
    if kind == 1:
        other = dict(zip(letters, rng.sample(letters, len(letters)), strict=True))
        return "".join((other.get(c) or rng.choice(letters)) if c.isalpha() else c for c in text.lower())
    first, size = rng.choice(SCRIPTS)
    if kind == 2:  # some letters of a script are frequent, most are not
        return "".join(chr(first + min(int(rng.expovariate(8 / size)), size - 1)) if c.isalpha() else c for c in text)
    moved: dict[str, str] = {}
    return "".join(moved.setdefault(c, chr(first + rng.randrange(size))) if c.isalpha() else c for c in text.lower())


@dataclass
class LanguageModel:
    """Embeddings and softmax; its last class, without a label, is that of texts in none of the languages."""

    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.embeddings) @ self.weights + self.bias

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x).astype(np.float64) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label (und without a letter), score and rejection of each text."""
        x, lettered = averages(texts, self.embeddings.shape[0])
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), ~lettered
        p = self.chances(x)[:, :-1]
        best, score = p.argmax(axis=1), np.where(lettered, p.max(axis=1), 0.0)
        return [self.labels[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.clip(score, 0, 1), ~lettered | (score < self.least)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 30, batch: int = 64, rate: float = 40.0, seed: int = SEED) -> LanguageModel:
    """Stochastic gradient descent on the averaged embeddings and the softmax; ``y``: places in ``labels``, or its length for none of them."""
    rng = np.random.default_rng(seed)
    model = LanguageModel(labels, rng.normal(0, 0.3, (x.shape[1], DIM)).astype(np.float32), np.zeros((DIM, len(labels) + 1), np.float32), np.zeros(len(labels) + 1, np.float32))
    steps = max(1, epochs * ((len(x) + batch - 1) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            some = order[i : i + batch]
            now = 1 - step / steps
            hidden = x[some] @ model.embeddings
            z = hidden @ model.weights + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ model.weights.T
            model.weights -= now * 0.5 * hidden.T @ p
            model.bias -= now * 0.05 * p.sum(axis=0)
            model.embeddings -= now * rate * x[some].T @ back
            step += 1
    return model


def calibrate(model: LanguageModel, x: np.ndarray, y: np.ndarray, loss: float = LOSS) -> LanguageModel:
    """Sets the temperature of least log-loss and the least score.

    All but a share ``loss`` of the right answers reach it; where the
    counterparts' scores leave room below, it lies halfway (by odds) between
    those of all but that share of them and the right answers.
    """
    if not len(x):
        return model
    costs = {}
    for t in np.geomspace(0.01, 100, 93):
        model.temperature = float(t)
        costs[float(t)] = -np.log(np.maximum(model.chances(x)[np.arange(len(x)), y], 1e-12)).mean()
    model.temperature = min(costs, key=costs.__getitem__)
    p = model.chances(x)
    known, score = y < len(model.labels), p[:, :-1].max(axis=1)
    right = known & (p[:, :-1].argmax(axis=1) == y)
    if right.any():
        odds = lambda v: np.log(np.clip(v, 1e-9, 1 - 1e-9) / (1 - np.clip(v, 1e-9, 1 - 1e-9)))
        high = odds(np.quantile(score[right], loss, method="lower"))
        low = odds(np.quantile(score[~known], 1 - loss)) if (~known).any() else high
        model.least = float(1 / (1 + np.exp(-(high if low > high else (low + high) / 2))))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> LanguageModel:
    """Learns from text and non-null lang of rows that may train; at most about ``sample`` rows, spread evenly over the languages."""
    known = docs.filter(may_train() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS).collect()}
    labels = sorted(sizes)
    if not labels:
        return LanguageModel([], np.zeros((buckets, DIM), np.float32), np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32))
    share = F.create_map(*[F.lit(v) for lang in labels for v in (lang, sample / len(labels) / sizes[lang])])
    drawn = (F.xxhash64(F.col("doc_id"), F.lit("sample")).bitwiseAND(F.lit(0xFFFFFF)) / float(1 << 24)) < share[F.col("lang")]
    some = known.filter(F.col("lang").isin(labels) & drawn).select("lang", (F.crc32(F.col("doc_id").cast("string")) % 5 == 4).alias("second"), "text")

    def make():
        def pack(text: str) -> bytes:
            return zlib.compress(subword_counts([text], buckets)[0].astype(np.uint32).tobytes(), 1)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out: list[list[bytes]] = [[], [], []]
            for text in texts_of(batch):
                rng = random.Random(zlib.crc32(text.encode()) ^ SEED)
                for into, made in zip(out, (text, passage(text, rng), counterpart(passage(text, rng, 3), rng)), strict=True):
                    into.append(pack(made))
            return [pa.array(x, pa.binary()) for x in out]

        return compute

    kinds = [T.StructField(c, T.BinaryType()) for c in ("counts", "passage", "counterpart")]
    rows = with_arrow_columns(some, kinds, make).drop("text").orderBy(F.xxhash64("counts"), "counts", "lang").limit(2 * sample).collect()  # the same order, however the rows are dealt
    x, y, second = np.zeros((3 * len(rows), buckets), np.float32), np.zeros(3 * len(rows), int), np.zeros(3 * len(rows), bool)
    for i, r in enumerate(rows):
        for k, kind in enumerate(kinds):
            x[3 * i + k] = np.frombuffer(zlib.decompress(bytes(r[kind.name])), np.uint32)
        y[3 * i : 3 * i + 3] = labels.index(r["lang"]), labels.index(r["lang"]), len(labels)
        second[3 * i : 3 * i + 3] = r["second"]
    full = x.sum(axis=1) > 0  # a passage may have no letters
    x, y, second = x[full], y[full], second[full]
    x /= x.sum(axis=1, keepdims=True)
    if len(rows) < 20:  # too few to spare any
        return calibrate(train(x, y, labels), x, y)
    return calibrate(train(x[~second], y[~second], labels), x[second], y[second])


def identify(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``docs`` with the language, score (0 to 1) and rejection of each whole text.

    A null text, or one without letters, is ``und`` with score 0 and rejected;
    one in none of the learned languages has a low score and is rejected; a model that learned nothing names all ``und`` and rejects only those. Rows
    repeat as they are; a column of ``docs`` with a new column's name goes; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, out = texts_of(batch), ([], [], [])
            for a, b in chunks(texts, 64, 300_000):
                for into, new in zip(out, held.predict(texts[a:b]), strict=True):
                    into.extend(new)
            return [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array([bool(x) for x in out[2]], pa.bool_())]

        return compute

    return with_arrow_columns(docs, [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())], make)


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs`` whose language the model does not reject, all columns kept.

    Null and empty texts, and those without letters, go; repeated rows stay or go
    together; without a model, one is learned from ``docs`` itself, and where no
    row has a language, whatever has a letter stays; an empty table gives no rows.
    """
    lang, score, rejected = own("lang", docs), own("score", docs), own("rejected", docs)
    return identify(docs, model or fit(docs), lang, score, rejected).filter(~F.col(rejected)).select(*docs.columns)

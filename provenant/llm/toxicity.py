"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are its words, word pairs and skip-grams (pairs one word
apart), and its words once more cut to stems of four, five and six letters;
all are hashed to 2**20 places, and a place has the root of the number of times
it is told as its value. The regression is trained in numpy with a rate per
coordinate and an L1 penalty, so few weights differ from zero; those alone are
sent to the executors.

Labels come from a bounded sample: about ``per_class`` rows of each label, at
most ``2 * per_class`` in all; each row weighs as many rows as it stands for,
so scores keep the rate of the labels. The sample is written once and read row
after row in each epoch, so the driver holds one row and the model.

Defined cases: a null or empty text has no feature and gets the base rate's
score; every row is scored by its text alone; without any labelled row every
score is 0.5; a score of the threshold counts as 1; an empty table gives no
rows; repeated rows are scored apiece; a very long text is read whole, one at a
time; :func:`score` puts its score into the column that it is told, and passes
all others through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, crc_mod, free_name, labelled_sample, map_rows, texts

BITS, PER_CLASS, THRESHOLD, EPOCHS = 20, 4_000, 0.5, 4
STEMS = (4, 5, 6)
_PAIR, _SKIP, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - BITS)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
words_of = re.compile(r"\w+").findall


class Hashes(dict):
    """Row in ``table`` by word: its hash and those of its stems (0: the word is
    no longer than that). Forgets all words when too many have come."""

    def __init__(self, size: int = 100_000):
        super().__init__()
        self.table = np.zeros((size, 1 + len(STEMS)), np.uint64)

    def __missing__(self, word):
        i = len(self)
        if i >= len(self.table):
            raise OverflowError
        code = lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        self.table[i] = [code(word), *(code(f"{k}^" + word[:k]) if len(word) > k else 0 for k in STEMS)]
        self[word] = i
        return i

    def of(self, words: list[str]) -> np.ndarray:
        try:
            return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        except OverflowError:
            self.clear()
            if len(set(words)) > len(self.table):
                self.table = np.zeros((len(set(words)), self.table.shape[1]), np.uint64)
            return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def places(text: str | None, hashes: Hashes) -> np.ndarray:
    """Places of all features, as often as they are told."""
    rows = hashes.of(words_of((text or "").lower()))
    h, stems = rows[:, 0], rows[:, 1:]
    grams = np.concatenate([h, h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + h[2:], stems[stems != 0]])
    return (grams * _MIX >> _SHIFT).astype(np.int64)


def features(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their values."""
    x, n = np.unique(at, return_counts=True)
    return x, np.sqrt(n)


class FTRL:
    """Logistic regression; z and n are the sums of McMahan et al.'s algorithm."""

    def __init__(self, alpha=0.15, beta=1.0, l1=6.0, l2=1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last place is the bias

    def weights(self, idx) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        l1 = np.where(idx == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, idx: np.ndarray, value: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(idx)
        g = weight * (1 / (1 + np.exp(-np.clip((w * value).sum(), -35, 35))) - y) * value
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g


Model = tuple[np.ndarray, np.ndarray, float]
NOTHING: Model = (np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)


def fit(
    rows: Callable[[int], Iterable[tuple[np.ndarray, np.ndarray, int]]], weight: dict[int, float], epochs: int = EPOCHS
) -> Model:
    """(places, weights, bias) of the model learned from (places, values, label) rows,
    which ``rows`` gives anew for each epoch."""
    model = FTRL()
    for epoch in range(epochs):
        for x, v, y in rows(epoch):
            model.step(np.append(x, 1 << BITS), np.append(v, 1.0), y, weight[y])
    at = np.flatnonzero(np.abs(model.z[:-1]) > model.l1)
    return at.astype(np.int32), model.weights(at).astype(np.float32), float(model.weights(np.array([1 << BITS]))[0])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from rows whose id's checksum is not divisible by 5."""
    own = labels.where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)
    ).select("doc_id", "toxic")
    counts = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    if not counts:
        return NOTHING
    sample = labelled_sample(own, "toxic", counts, per_class, 2 * per_class, F.col("doc_id"), F.col("toxic"))
    few = F.broadcast(sample)  # at most 2 * per_class rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), texts(b.column(1), 50), strict=True):
                x, v = features(places(t, hashes))
                x, v = x.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([y], pa.int32()), pa.array([xxhash.xxh64_intdigest(x + v) >> 1], pa.int64()),
                        pa.array([x], pa.binary()), pa.array([v], pa.binary())
                    ],
                    names=["toxic", "h", "x", "v"]
                )

    part = docs.select("doc_id", "text").join(few, "doc_id").select("toxic", "text").mapInArrow(
        run, "toxic int, h long, x binary, v binary"
    )
    with Scratch(docs.sparkSession) as tmp:
        part = tmp.table(part, "toxicity-sample")
        seen = {r[0]: r[1] for r in part.groupBy("toxic").count().collect()}
        if not seen:
            return NOTHING
        raw = {y: counts[y] / n for y, n in seen.items()}
        mean = sum(raw[y] * n for y, n in seen.items()) / sum(seen.values())

        def rows(epoch: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            order = part.orderBy(F.xxhash64("h", F.lit(epoch)), "h", "toxic")  # whatever the partitions
            for r in order.toLocalIterator():
                yield np.frombuffer(r["x"], np.int32), np.frombuffer(r["v"], np.float32), r["toxic"]

        return fit(rows, {y: w / mean for y, w in raw.items()})


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """``docs`` with the score as column ``to`` (replaced if there is one); all
    other columns pass through, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    kept = [i for i, c in enumerate(docs.columns) if c != to]
    names = [f"c{i}" for i in range(len(kept) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_, weights, bias = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[at_] = weights
        hashes = Hashes()
        for b in batches:
            out = np.empty(b.num_rows)
            for i, text in enumerate(texts(b.column(at), 100)):
                x = places(text, hashes)
                x, v = features(x[w[x] != 0])
                out[i] = bias + (w[x] * v).sum(dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(p)], names=names)

    schema = StructType([docs.schema[i] for i in kept]).add(to, "double")
    return map_rows(docs, run, schema)


def classify(
    docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    s = score(docs.select("doc_id", "text"), train(docs, labels, per_class))
    return s.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def reject_toxic(
    docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` without those that are scored toxic."""
    name = free_name(docs)
    return score(docs, train(docs, labels, per_class), name).where(F.col(name) < threshold).drop(name)

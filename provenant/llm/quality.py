"""Quality: random-indexing word vectors, pooled per document, under a small network.

Every word has a sparse ternary index vector; a word's context vector is the
sum of the index vectors of its neighbours over all documents, kept in a table
of 2**13 hashed words. A document is the mean and the spread of its words'
unit vectors, and its length. A two-layer network is trained in numpy on the
pooled vectors of a bounded labelled sample, and its logits are divided by a
temperature fitted on a part that training did not see.

The co-occurrence sums cover every document and are added up per word before
and after the shuffle; what reaches the driver is the table (fixed size) and
the sample's pooled vectors (about ``per_class`` rows of each label, at most
``2 * per_class``).

Defined cases: a null or empty text has no words and pools to zeros; without
labelled rows every score is 0.5; a score of the threshold counts as 1; an empty
table gives no rows; repeated rows are scored apiece; a very long text is read
whole, a slice of its words at a time; :func:`score` puts its score into the
column that it is told, and passes all others through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_mod, labelled_sample, map_rows, texts

ROWS, DIMS, WINDOW, NONZERO = 1 << 13, 32, 2, 4
PER_CLASS, THRESHOLD = 5_000, 0.3
tokens_of = re.compile(r"\w+|[^\w\s]+").findall
_SPACE = re.compile(r"\s").search


class _Rows(dict):
    """Row of the table by token."""

    def __missing__(self, token):
        r = xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) % ROWS
        if len(self) >= 500_000:
            self.clear()
        self[token] = r
        return r


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((ROWS, DIMS)), 1)[:, :NONZERO]
    return places, rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))


def _slices(text: str | None, rows: _Rows, size: int = 1 << 18) -> Iterator[np.ndarray]:
    """Rows of the tokens of a text, a slice of about ``size`` characters at a time;
    slices end at white space, which no token holds."""
    text, at = text or "", 0
    while at < len(text):
        m = _SPACE(text, at + size) if at + size < len(text) else None
        end = m.start() if m else len(text)
        toks = tokens_of(text, at, end)
        if toks:
            yield np.fromiter(map(rows.__getitem__, toks), np.int64, len(toks))
        at = end


def cooccurrences(
    many: Iterable[str | None], rows: _Rows, places: np.ndarray, signs: np.ndarray, size: int = 1 << 18
) -> np.ndarray:
    """Sums of the index vectors of the neighbours of each row's words."""
    total = np.zeros(ROWS * DIMS)
    for text in many:
        before = np.zeros(0, np.int64)
        for part in _slices(text, rows, size):
            w = np.concatenate([before, part])
            at, by = [], []
            for k in range(1, WINDOW + 1):
                lo = max(0, len(before) - k)  # pairs within what came before are counted already
                for word, context in ((w[lo:-k], w[lo + k :]), (w[lo + k :], w[lo:-k])):
                    at.append((word[:, None] * DIMS + places[context]).ravel())
                    by.append(signs[context].ravel())
            at, by = np.concatenate(at), np.concatenate(by)
            if len(at) < ROWS * DIMS:
                np.add.at(total, at, by)
            else:
                total += np.bincount(at, by, ROWS * DIMS)
            before = w[-WINDOW:]
    return total


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all rows, from the words of every document."""
    cols = [f"d{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = (t for b in batches for t in texts(b.column(0), 100))
        t = cooccurrences(all_, _Rows(), *_index_vectors()).reshape(ROWS, DIMS)
        own = np.flatnonzero(t.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), *(pa.array(t[own, i].astype(np.int64)) for i in range(DIMS))],
            names=["row", *cols]
        )

    part = docs.select("text").mapInArrow(run, "row int, " + ", ".join(f"{c} long" for c in cols))
    got = part.groupBy("row").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()  # at most ROWS rows
    v = np.zeros((ROWS, DIMS), np.float32)
    if len(got):
        v[got["row"].to_numpy()] = got[cols].to_numpy()
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def pooled(text: str | None, vectors: np.ndarray, rows: _Rows) -> np.ndarray:
    n, total, square = 0, np.zeros(DIMS), np.zeros(DIMS)
    for w in _slices(text, rows):
        v = vectors[w]
        n += len(w)
        total += v.sum(0, dtype=np.float64)
        square += np.einsum("ij,ij->j", v, v, dtype=np.float64)
    if not n:
        return np.zeros(2 * DIMS + 1, np.float32)
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return np.concatenate([mean, spread, [np.log1p(n) / 10]]).astype(np.float32)


class Network:
    """Two layers and a temperature."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2, _ = self.parts
        return np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.parts[-1], -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on weighted log loss; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    x, y, weight = x[order].astype(float), y[order].astype(float), weight[order]
    held = np.arange(len(x)) % 5 == 0
    tx, ty, tw = x[~held], y[~held], weight[~held]
    if not len(tx):
        tx, ty, tw = x, y, weight
    mean, scale = tx.mean(0), tx.std(0) + 1e-6
    p = [
        rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden),
        rng.normal(0, hidden**-0.5, hidden), np.zeros(())
    ]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    tx = (tx - mean) / scale
    for epoch in range(epochs):
        for idx in np.array_split(rng.permutation(len(tx)), max(1, len(tx) // 64)):
            a = tx[idx] @ p[0] + p[1]
            h = np.maximum(a, 0)
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -35, 35))) - ty[idx]) * tw[idx] / len(idx)
            da = np.outer(e, p[2]) * (a > 0)
            grads = [tx[idx].T @ da + 1e-4 * p[0], da.sum(0), h.T @ e + 1e-4 * p[2], e.sum()]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (1 - epoch / epochs / 1.2) * (m[i] / (1 - 0.9**t)) / (
                    np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8
                )
    net = Network([mean, scale, *p, np.float64(1.0)])
    if held.any():
        z = net.logits(x[held])
        loss = lambda c: float((weight[held] * (np.logaddexp(0, z / c) - y[held] * z / c)).mean())
        net.parts[-1] = np.float64(min(np.geomspace(0.5, 8, 49), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, Network | None]:
    """Word vectors of all documents, and the network learned from the labels of
    rows whose id's checksum is not divisible by 5."""
    vectors = word_vectors(docs)
    own = labels.where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)
    ).select("doc_id", "quality")
    counts = {r[0]: r[1] for r in own.groupBy("quality").count().collect()}
    if not counts:
        return vectors, None
    few = F.broadcast(
        labelled_sample(own, "quality", counts, per_class, 2 * per_class, F.col("doc_id"), F.col("quality"))
    )
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for b in batches:
            x = [pooled(t, sent.value, rows) for t in texts(b.column(1), 100)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32()))], names=["quality", "x"])

    got = docs.select("doc_id", "text").join(few, "doc_id").select("quality", "text").mapInArrow(
        run, "quality int, x array<float>"
    ).toPandas()
    if not len(got):
        return vectors, None
    x, y = np.stack(got["x"].to_list()), got["quality"].to_numpy()
    order = np.lexsort([*x.T, y])  # the same order whatever the partitions
    x, y = x[order], y[order]
    weight = np.array([counts[v] for v in y]) / np.array([(y == v).sum() for v in y])
    return vectors, fit(x, y, weight / weight.mean())


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None], to: str = "score") -> DataFrame:
    """``docs`` with the score as column ``to`` (replaced if there is one); all
    other columns pass through, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    kept = [i for i, c in enumerate(docs.columns) if c != to]
    names = [f"c{i}" for i in range(len(kept) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = sent.value
        rows = _Rows()
        for b in batches:
            if net is None or not b.num_rows:
                p = np.full(b.num_rows, 0.5)
            else:
                p = net.proba(np.stack([pooled(t, vectors, rows) for t in texts(b.column(at), 100)]))
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

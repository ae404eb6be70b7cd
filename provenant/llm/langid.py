"""Language identification by a byte convolutional network.

The bytes of the lower-cased text are embedded, read by filters two, three and four bytes wide, pooled to
their maximum over a window and classified by a softmax; all of it is trained
in numpy on labelled windows. A whole text is cut into windows of fixed
length; its language is the one with the largest mean probability, windows
weighing as many bytes as they hold.

Training takes a bounded sample: about ``per_class`` documents of each of the
``max_classes`` most frequent languages, at most ``total`` in all, and of each
document's windows those ``windows_each`` whose hashes are least, wherever in
the text they lie.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
of equally probable languages the first by name is told; with nothing to learn
from every text is ``und``; an empty table gives no rows; repeated rows are
labelled apiece; a very long text is read whole, a slice of its windows at a
time; only ``doc_id``, ``text`` and, in training, ``lang`` are read, so no further
column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, order_hash, texts

WINDOW, EMBED, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 12
PER_CLASS, TOTAL, MAX_CLASSES, WINDOWS_EACH = 1_000, 20_000, 512, 3
_SPAN = max(WIDTHS)


def has_letter(text: str) -> bool:
    """Whether some character is a letter (Unicode category L): no figure, fraction or sign is."""
    return any(map(str.isalpha, text))


def windows(data: bytes) -> np.ndarray:
    """The bytes as rows of a fixed length, the last one filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class Net:
    def __init__(self, n_classes: int, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.emb[0] = 0
        self.mask = np.zeros((_SPAN * EMBED, len(WIDTHS) * FILTERS), np.float32)  # narrow filters see fewer bytes
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.conv = (rng.normal(0, 0.25, self.mask.shape) * self.mask).astype(np.float32)
        self.cb = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.2, (len(self.cb), n_classes)).astype(np.float32)
        self.ob = np.zeros(n_classes, np.float32)

    def unfold(self, x: np.ndarray) -> np.ndarray:
        e = self.emb[x].reshape(len(x), -1)
        return sliding_window_view(e, _SPAN * EMBED, axis=1)[:, ::EMBED].reshape(-1, _SPAN * EMBED)

    def proba(self, x: np.ndarray, chunk: int = 48) -> np.ndarray:
        out = np.empty((len(x), len(self.ob)), np.float32)
        for s in range(0, len(x), chunk):
            part = x[s : s + chunk]
            a = (self.unfold(part) @ self.conv).reshape(len(part), WINDOW - _SPAN + 1, -1).max(1) + self.cb
            z = np.maximum(a, 0) @ self.out + self.ob
            z = np.exp(z - z.max(1, keepdims=True))
            out[s : s + chunk] = z / z.sum(1, keepdims=True)
        return out

    def train(
        self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 700, batch: int = 96, rate: float = 0.004,
        seed: int = 4
    ) -> None:
        rng = np.random.default_rng(seed)
        names = ("emb", "conv", "cb", "out", "ob")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        span = WINDOW - _SPAN + 1
        for t in range(1, steps + 1):
            i = rng.integers(0, len(x), batch)
            u = self.unfold(x[i])
            a = (u @ self.conv).reshape(batch, span, -1)
            top = a.argmax(1)
            p = np.take_along_axis(a, top[:, None], 1)[:, 0] + self.cb
            h = np.maximum(p, 0)
            z = h @ self.out + self.ob
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(batch), y[i]] -= 1
            z *= (weight[i] / batch)[:, None]
            dp = (z @ self.out.T) * (p > 0)
            at = np.arange(batch)[:, None] * span + top  # the one place each filter saw
            seen = u.reshape(-1, _SPAN * EMBED)[at]
            dconv = np.einsum("bfk,bf->kf", seen, dp) * self.mask
            dseen = (dp[:, :, None] * self.conv.T[None]).reshape(batch, -1, _SPAN, EMBED)
            bytes_ = sliding_window_view(x[i], _SPAN, axis=1).reshape(-1, _SPAN)[at]
            demb = np.zeros_like(self.emb)
            np.add.at(demb, bytes_.ravel(), dseen.reshape(-1, EMBED))
            demb[0] = 0
            grads = {"emb": demb, "conv": dconv, "cb": dp.sum(0), "out": h.T @ z, "ob": z.sum(0)}
            step = rate * (1 - 0.9 * t / steps)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                setattr(
                    self, k,
                    (
                        getattr(self, k) - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
                    ).astype(np.float32)
                )


def drawn(text: str, windows_each: int) -> list[tuple[int, np.ndarray]]:
    """(hash, window) of the windows of a text that training takes; the last one
    of a longer text is left out if it is not full."""
    w = windows(text.lower().encode("utf-8", "replace"))
    w = w[:-1] if len(w) > 1 and not w[-1].all() else w
    codes = [xxhash.xxh64_intdigest(x.tobytes(), 5) >> 1 for x in w]
    out: list[tuple[int, np.ndarray]] = []
    for i in sorted(range(len(w)), key=codes.__getitem__):
        if len(out) == windows_each:
            break
        if has_letter(w[i].tobytes().decode("utf-8", "ignore")):
            out.append((codes[i], w[i]))
    return out


def train(
    docs: DataFrame, per_class: int = PER_CLASS, total: int = TOTAL, max_classes: int = MAX_CLASSES,
    windows_each: int = WINDOWS_EACH
) -> tuple[list[str], Net | None]:
    """Learns from labelled rows whose id's checksum modulo 4 is not 2."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2))
    counts = {
        r[0]: r[1] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_classes).collect()
    }
    if not counts:
        return [], None
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, per_class / n) * 2**32)).otherwise(share)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (lang, *v) for lang, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True)
                for v in drawn(t, windows_each)
            ]
            cols = ([r[0] for r in rows], [r[1] for r in rows], [r[2].tobytes() for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)],
                names=["lang", "h", "x"]
            )

    part = own.where(
        order_hash(F.col("doc_id"), seed=7) < share
    ).select("lang", "text").mapInArrow(draw, "lang string, h long, x binary")
    rows = part.orderBy("h", "x", "lang").limit(total * windows_each).collect()  # windows of a fixed size
    langs = sorted(counts)
    x, y = [np.frombuffer(r["x"], np.uint8) for r in rows], [langs.index(r["lang"]) for r in rows]
    if not x:
        return [], None
    order = sorted(range(len(x)), key=lambda i: (y[i], x[i].tobytes()))
    x, y = np.stack([x[i] for i in order]), np.array([y[i] for i in order])
    # a text may be shorter than a window: half of the rows are cut short
    rng = np.random.default_rng(9)
    short = x.copy()
    for i, k in enumerate(rng.integers(8, WINDOW, len(short))):
        short[i, k:] = 0
    weight = 1 / np.bincount(y, minlength=len(langs))[y]
    net = Net(len(langs))
    net.train(np.concatenate([x, short]), np.concatenate([y, y]), np.tile(weight / weight.mean(), 2).astype(np.float32))
    return langs, net


def predict(docs: DataFrame, model: tuple[list[str], Net | None]) -> DataFrame:
    """(doc_id, lang_pred, score) of every document, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, net = sent.value
        for b in batches:
            pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            rows, owner, weight = [], [], []

            def flush():
                if rows:
                    x, who, by = np.concatenate(rows), np.concatenate(owner), np.concatenate(weight)
                    p = net.proba(x).astype(np.float64) * by[:, None]
                    first = np.flatnonzero(np.r_[True, np.diff(who) != 0])
                    total = np.add.reduceat(p, first) / np.add.reduceat(by, first)[:, None]
                    for i, q in zip(who[first], total, strict=True):
                        pred[i], score[i] = langs[int(q.argmax())], min(1.0, float(q.max()))
                    rows.clear(), owner.clear(), weight.clear()

            held = 0
            for i, t in enumerate(texts(b.column(1), 100)):
                if net is None or not t or not has_letter(t):
                    continue
                data = t.lower().encode("utf-8", "replace")
                w = windows(data)
                size = np.full(len(w), float(WINDOW))
                size[-1] = len(data) - (len(w) - 1) * WINDOW
                rows.append(w), owner.append(np.full(len(w), i)), weight.append(size)
                held += len(w)
                if held > 4_000:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def identify(docs: DataFrame, *, per_class: int = PER_CLASS, total: int = TOTAL) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    return predict(docs, train(docs, per_class, total)).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )
